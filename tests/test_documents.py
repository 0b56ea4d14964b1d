"""Report documents by their texts, and outputs that are published together."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import documents
from plumbline.sources import bundles, stores


def test_summary_layout(spark):
    headline = spark.createDataFrame([(0.5, 2 / 3, None, 1.0, 0.25)], "conflict_f1 double, extraction_recall double, hallucination_rate double, recall_at_k double, judge_accuracy double")
    performance = spark.createDataFrame([("seconds", 1.0, 0.5, 2.0, None), ("a|b\nc", 3.0, 3.0, 3.0, 0.0)], "metric string, median double, least double, most double, spread double")
    run = spark.createDataFrame([(8, None)], "batch_size int, repeats int")
    errors = spark.createDataFrame([], "cause string, n long")
    assert documents.text(spark, documents.benchmark_summary(headline, errors, performance, run)) == """# Benchmark summary

## Quality

| Metric | Value |
|---|---:|
| Conflict F1 | 0.5000 |
| Extraction recall | 0.6667 |
| Hallucination rate | N/A |
| Recall at k | 1.0000 |
| Judge accuracy | 0.2500 |

## Errors by first cause

| Cause | Count |
|---|---:|
| N/A | N/A |

## Performance

| Metric | Median | Least | Most | Spread |
|---|---:|---:|---:|---:|
| a\\|b c | 3.0000 | 3.0000 | 3.0000 | 0.0000 |
| seconds | 1.0000 | 0.5000 | 2.0000 | N/A |

Batch size: 8; repeats: N/A.
"""


def test_batch_layout(spark):
    base = spark.createDataFrame([(0.875, None)], "recall double, precision double")
    fields = "batch_size int, mean_batch double, calls int, retries int, recoveries int, input_tokens int, padded_tokens int, output_tokens int, ttft_p50 double, ttft_p95 double, prefill double, decode double, seconds double, wall double, decode_rate double, story_rate double, peak_bytes long, recall double, precision double, pending int"
    arms = spark.createDataFrame([(8, 6.5, 10, 1, 0, 900, 1000, 300, 12.0, 30.25, 1.0, 4.0, 5.0, 5.5, 75.0, 0.5, 3 * 2**30, 0.9, 0.8, 2), (1, 1.0, 60, 1, 2, 900, 900, 300, None, None, 1.0, 9.0, 10.0, 11.0, 33.333, 0.25, None, None, None, 0)], fields)
    failures = spark.createDataFrame([(8, "late\nreply"), (4, "none")], "batch_size int, reason string")
    got = documents.text(spark, documents.batch_comparison(base, arms, failures)).split("\n")
    assert got[:6] == ["# Extraction in batches", "", "Baseline: recall 87.50%, precision —.", "", "Only extraction ran again; events that are new or changed count once they are reviewed.", ""]
    assert got[8].startswith("| Batch | Mean batch | Calls |") and got[9] == "|" + "|".join(["---:"] * 12) + "|"
    assert got[10] == "| 1 | 1.00 | 60 | 1 / 2 | 900 / 900 / 300 | — / — | 1.00 / 9.00 / 10.00 / 11.00 | 33.33 | 0.250 | — | — / — | 0 |"
    assert got[11] == "| 8 | 6.50 | 10 | 1 / 0 | 900 / 1000 / 300 | 12.00 / 30.25 | 1.00 / 4.00 / 5.00 / 5.50 | 75.00 | 0.500 | 3.00 | 90.00% / 80.00% | 2 |"
    assert got[12:] == ["", "## Failures", "", "- 4: none", "- 8: late reply", ""]
    assert documents.text(spark, documents.batch_comparison(base, arms, failures.limit(0))).endswith("## Failures\n\n- none\n")


def test_case_layout(spark):
    totals = spark.createDataFrame([(4, 3, 2, 5, 6, 4, 1)], "inputs int, valid int, overall int, claims_found int, claims int, verdicts int, complete int")
    groups = spark.createDataFrame([("b", 1, 1, 2, 2, 0), ("a", 3, 1, 2, 4, 1)], "grp string, inputs int, overall int, verdicts int, claims int, complete int")
    confusion = spark.createDataFrame([("no", 1, 0), ("yes", 0, 3)], "expected string, yes int, `not said` int")
    times = spark.createDataFrame([("warm", 3, 1.5, 2.0625)], "name string, n int, median double, p95 double")
    cases = spark.createDataFrame([("c2", "a", "yes", None, 0, 2, 1.0, False), ("c1", "b", "no", "no", 2, 2, 0.125, True)], "case_id string, grp string, expected string, observed string, verdicts int, claims int, seconds double, complete boolean")
    spec = documents.case_report(totals, groups, confusion, times, cases, ("yes", "not said"))
    assert documents.text(spark, spec) == """# Checks of single claims

## Totals

- Valid replies: 3/4
- Overall label as expected: 2/4
- Claims found: 5/6
- Verdicts right: 4/6
- All standards met: 1/4

## By group

| Group | Inputs | Overall | Verdicts | Complete |
|---|---:|---:|---:|---:|
| a | 3 | 1 | 2/4 | 1 |
| b | 1 | 1 | 2/2 | 0 |

## Confusion

| Expected | yes | not said |
|---|---:|---:|
| no | 1 | 0 |
| yes | 0 | 3 |

## Times

- warm: n=3, median 1.500 s, p95 2.063 s

## Cases

| Case | Group | Expected | Observed | Verdicts | Seconds | Complete |
|---|---|---|---|---:|---:|---|
| c1 | b | no | no | 2/2 | 0.13 | yes |
| c2 | a | yes | N/A | 0/2 | 1.00 | no |
"""
    with pytest.raises(ValueError, match="summary"):
        documents.text(spark, spec, most=10)


def test_outputs_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    calls = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, note string")
    with pytest.raises(ValueError, match="no published version"):
        bundles.load(spark, folder)
    first = bundles.publish(spark, folder, {"calls": calls, "fields": calls.select("id"), "report.md": "# é\n"}, {"fields": "csv"}, {"run": 1})
    got = bundles.load(spark, folder)
    assert sorted(map(tuple, got["calls"].collect())) == [(1, "a,b"), (2, None)] and sorted(r.id for r in got["fields"].collect()) == [1, 2] and got["report.md"] == "# é\n"
    broken = calls.select(F.when(F.col("id") > 0, F.raise_error(F.lit("half way"))).cast("int").alias("id"))
    with pytest.raises(Exception, match="half way"):
        bundles.publish(spark, folder, {"calls": calls.limit(1), "fields": broken, "report.md": "new"})
    assert bundles.load(spark, folder)["report.md"] == "# é\n" and bundles.load(spark, folder)["calls"].count() == 2
    second = bundles.publish(spark, folder, {"calls": calls.limit(1)}, {"calls": "json"})
    assert first != second and list(bundles.load(spark, folder)) == ["calls"] and bundles.load(spark, folder, first)["calls"].count() == 2
    bundles.verify(spark, folder)
    calls.write.mode("append").json(f"{folder}/version={second}/calls")
    with pytest.raises(ValueError, match="differs"):
        bundles.verify(spark, folder)
    with pytest.raises(ValueError, match="called"):
        bundles.publish(spark, folder, {"../x": calls})
    assert stores.read_text(spark, f"{folder}/CURRENT").strip() == second
