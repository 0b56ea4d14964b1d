import json

from plumbline.functions import render
from plumbline.operators import story


def models():
    """Inner functions travel to the tasks by value, which those of a test module don't."""

    def extractor(prompts):
        out = []
        for p in prompts:
            targets = json.loads(p)["targets"]
            event = {"actors": ["Ann"], "event": "Ann flies", "source_ids": [targets[0]["id"]], "modality": "observed", "check_reason": "mechanism"}
            bad = {**event, "actors": ["Bob"]}
            out.append((json.dumps({"events": [event, bad], "ignored_spans": [{"source_Ids": t["id"], "reason": "routine"} for t in targets[1:]], "non_event_span_ids": []}), None))
        return out


    def judge(prompts):
        out = []
        for p in prompts:
            quote = json.loads(p)["evidence"][0]
            a = {"same_subject": True, "evidence_applicable": True, "relation": "direct_conflict", "can_both_be_true": False, "assumptions": []}
            out.append((json.dumps({"verdict": "contradiction", "reason": "r", "citations": [{"evidence_id": quote["evidence_id"], "quote": quote["text"]}], "assessment": a}), None))
        return out

    return extractor, judge


def test_chain(spark):
    extractor, judge = models()
    stories = spark.createDataFrame([("s1", "Ann flies, then rests. Bob sleeps.")], "case_id string, text string")
    chunks = spark.createDataFrame([("c1", 0, "nobody flies"), ("c2", 1, "water")], "chunk_id string, ord long, text string")
    events, dispositions = story.extract(stories, extractor)
    assert {r.event_no: r.error for r in events.collect()} == {0: None, 1: "actor"}
    assert story.coverage(stories, dispositions).first().complete
    r = story.check_stories(stories, chunks, extractor, judge).first()
    assert (r.status, r.verdict, r.contradiction, r.findings) == ("ok", "contradiction", 1, ["s1-1-0"])


def test_markdown(spark):
    d = spark.createDataFrame([("a|b", None), ("c", 0.5)], "x string, y double")
    assert render.table(d, ["x"]).splitlines()[2:] == ["| a\\|b | N/A |", "| c | 0.5000 |"]
