"""Quality classifier: interpolated modified Kneser-Ney character model of trusted text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop, pinned_scans, row_name, settled, small_batches, small_enough, store

ORDER = 3
#: Characters of a block of documents, whose n-grams are counted and looked up together.
BLOCK_CHARS = 4_000_000
#: Trusted ids are sent to all tasks up to this number (8 bytes each); beyond, they are joined by a shuffle.
MOST_IDS = 2_000_000
#: Languages whose few numbers are sent to all tasks.
MOST_LANGS = 10_000
#: One in so many trusted documents is kept from training, and limits are taken on these.
HELD_OUT = 5
#: Short texts scatter more: a limit stands for texts that are longer by this many average characters.
PRIOR_CHARS = 200
#: Share of held-out documents that lie further above their language's median than limits do, and the bits added.
TAIL, MARGIN = 0.02, 0.02
#: Steps of the grid on which quantiles are taken, per unit of bits.
GRID = 2000
#: Marks of a text's ends: code points that Unicode keeps for internal use.
START, END = "\ufdd0", "\ufdd1"


def _grams(docs: list[tuple[str, str]], order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]]]:
    """For a block of (language, text): each position's n-gram number, documents' starts, and the n-grams.

    A text stands between START characters and an END, which count as U+FFFD inside it; a language's own n-grams
    have own numbers.
    """
    langs = {x: i for i, x in enumerate(dict.fromkeys(lang for lang, _ in docs))}
    codes, which, starts, at = [], [], [], 0
    for lang, text in docs:
        text = text.replace(START, "\ufffd").replace(END, "\ufffd")
        c = np.frombuffer((START * (order - 1) + text + END).encode("utf-32-le", "replace"), "<u4")
        codes.append(c)
        which.append(langs[lang])
        starts.append(at)
        at += len(c)
    chars = np.concatenate(codes)
    known = np.zeros(int(chars.max()) + 1, dtype=bool)
    known[chars] = True
    used = np.flatnonzero(known)
    room = len(langs) * len(used) ** order
    kind = np.int32 if room < 2**31 else np.int64
    dense = np.zeros(len(known), dtype=kind)
    dense[used] = np.arange(len(used))
    c = dense[chars]
    number = np.repeat(np.array(which, dtype=kind), [len(x) for x in codes])
    for k in range(order - 1, -1, -1):
        number *= kind(len(used))
        number[k:] += c[: len(c) - k]
    inside = np.ones(at, dtype=bool)  # n-grams that end in the START characters are none
    for k in range(order - 1):
        inside[np.array(starts) + k] = False
    number = number[inside]
    starts = np.array(starts) - (order - 1) * np.arange(len(starts))
    if room <= 1 << 25:
        there = np.zeros(room, dtype=bool)
        there[number] = True
        seen = np.flatnonzero(there)
        where = np.zeros(int(seen[-1]) + 1, dtype=np.uint16 if len(seen) < 1 << 16 else np.int32)
        where[seen] = np.arange(len(seen))
        place = where[number]
    else:
        seen, place = np.unique(number, return_inverse=True)
    letters, names = [chr(x) for x in used], list(langs)
    grams, rest = [], seen
    for _ in range(order):
        grams.append(rest % len(used))
        rest = rest // len(used)
    back = [[letters[i] for i in g] for g in reversed(grams)]
    return place, starts, [(names[i], "".join(x)) for i, *x in zip(rest, *back, strict=True)]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Consecutive rows in blocks of about BLOCK_CHARS characters."""
    held, size = [], 0
    for batch in batches:
        lengths = batch["text"].str.len().to_numpy()
        cut = 0
        for i, n in enumerate(lengths):
            size += n + 8
            if size >= BLOCK_CHARS:
                held.append(batch.iloc[cut : i + 1])
                yield pd.concat(held)
                held, size, cut = [], 0, i + 1
        if cut < len(batch):
            held.append(batch.iloc[cut:])
    if held:
        yield pd.concat(held)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: n-gram counts of all texts, summed per block before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            place, _, grams = _grams(list(zip(block["lang"], block["text"], strict=True)), order)
            langs, texts = zip(*grams, strict=True)
            yield pd.DataFrame({"lang": langs, "gram": texts, "n": np.bincount(place, minlength=len(grams))})

    parts = docs.select("lang", "text").mapInPandas(count, "lang string, gram string, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: the modified discounts from how many n-grams were seen 1, 2, 3, 4 times."""
    seen = [F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))

    def d(i: int) -> Column:
        est = F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))
        return F.least(F.greatest(F.coalesce(est, F.lit(0.5 * i)), F.lit(0.1)), F.lit(0.95 * i)).alias(f"d{i}")

    return counts.groupBy("lang").agg(*seen).select("lang", d(1), d(2), d(3))


def train(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (lang, gram, p) of seen n-grams and (lang, context, backoff).

    The highest order counts occurrences, lower ones in how many contexts an n-gram occurs. p is
    interpolated with the order below; for an unseen n-gram the backoff weight of its context times
    the order below holds, and below order 1 a uniform share over seen characters and one unseen.
    """
    by_order = {order: counts}
    for k in range(order - 1, 0, -1):
        above = by_order[k + 1]
        by_order[k] = above.groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    model: list[tuple[DataFrame, DataFrame]] = []
    for k in range(1, order + 1):
        c = by_order[k].withColumn("context", F.substring("gram", 1, k - 1) if k > 1 else F.lit(""))
        d = _discounts(by_order[k])  # a row for each language
        d = F.broadcast(d) if small_enough(d, MOST_LANGS) else d
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        c = c.join(d, "lang").withColumn("cut", cut)
        contexts = c.groupBy("lang", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("backoff"), F.count("*").alias("kinds"))
        c = c.join(contexts, ["lang", "context"])
        own = (F.col("n") - F.col("cut")) / F.col("total")
        if k == 1:
            c = c.withColumn("p", own + F.col("backoff") / (F.col("kinds") + 1))
            contexts = contexts.withColumn("backoff", F.col("backoff") / (F.col("kinds") + 1))
        else:
            below = model[-1][0].select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
            c = c.withColumn("tail", F.substring("gram", 2, k - 1)).join(below, ["lang", "tail"])
            c = c.withColumn("p", own + F.col("backoff") * F.col("lower"))
        model.append((store(c.select("lang", "gram", "p"), f"kn-p{k}"), store(contexts.select("lang", "context", "backoff"), f"kn-b{k}")))
    return model


def bits(wanted: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """wanted (lang, gram) with ``bits``: -log2 p; null for languages without a model."""
    out = wanted
    value, weight = F.lit(None).cast("double"), F.lit(1.0)
    order = len(model)
    for k in range(order, 0, -1):
        p, b = model[k - 1]
        key = F.substring("gram", order - k + 1, k)
        context = F.substring("gram", order - k + 1, k - 1) if k > 1 else F.lit("")
        out = out.withColumns({"__g": key, "__c": context})
        out = out.join(p.select("lang", F.col("gram").alias("__g"), F.col("p").alias(f"__p{k}")), ["lang", "__g"], "left")
        out = out.join(b.select("lang", F.col("context").alias("__c"), F.col("backoff").alias(f"__b{k}")), ["lang", "__c"], "left")
        value = F.coalesce(value, weight * F.col(f"__p{k}"))
        weight = weight * F.coalesce(F.col(f"__b{k}"), F.lit(1.0) if k > 1 else F.lit(None).cast("double"))
    value = F.coalesce(value, weight)
    return out.select(*wanted.columns, (-F.log2(value)).alias("bits"))


def score(docs: DataFrame, model: list[tuple[DataFrame, DataFrame]], order: int = ORDER) -> DataFrame:
    """doc_id, row, lang, n (characters and the end), bits (of the whole text; null without a model of the language).

    Documents are scored in blocks. A block sends each of its distinct n-grams once to
    the shards of the model and gets its bits back; its texts travel once, compressed, to meet
    them. So what is joined grows with blocks times distinct n-grams, not with the text. Documents are read twice,
    and cut into the same blocks each time: from files whose splits are held, or else from a written table.
    """
    docs = settled(docs, "kn-docs")

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            _, _, grams = _grams(list(zip(block["lang"], block["text"], strict=True)), order)
            langs, texts = zip(*grams, strict=True)
            yield pd.DataFrame({"block": _name(block), "slot": np.arange(len(grams), dtype=np.int32), "lang": langs, "gram": texts})

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in _blocks(batches):
            yield pd.DataFrame({"block": [_name(block)], "rows": [zlib.compress(block.to_json(orient="values", force_ascii=False).encode("utf-8", "surrogatepass"), 1)]})

    def meet(key: tuple, rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        import json

        out = []
        slots = answers["slot"].to_numpy()
        values = np.full(slots.max(initial=-1) + 1, np.nan)
        values[slots] = answers["bits"].to_numpy(dtype=float)
        for data in rows["rows"]:  # equal blocks share a name and get the same answers, each once for every block
            docs = json.loads(zlib.decompress(data).decode("utf-8", "surrogatepass"))
            place, starts, grams = _grams([(d[2], d[3]) for d in docs], order)
            if len(grams) != len(values):
                raise ValueError("a block of documents was not read the same way twice")
            sums = np.add.reduceat(values[place], starts)
            ends = np.append(starts[1:], len(place))
            out += [(None if d[0] is None else int(d[0]), int(d[1]), d[2], int(e - s), None if np.isnan(x) else float(x)) for d, s, e, x in zip(docs, starts, ends, sums, strict=True)]
        made = pd.DataFrame(out, columns=["doc_id", "row", "lang", "n", "bits"], dtype=object)
        return made.astype({"doc_id": "Int64", "row": "int64", "n": "int64", "bits": "float64"})

    # Numbers as text: pandas and JSON would round large ones.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("row").cast("string").alias("row"), "lang", "text")
    with pinned_scans(docs.sparkSession):
        asked = store(rows.mapInPandas(wanted, "block string, slot int, lang string, gram string"), "kn-asked")
        known = bits(asked.select("lang", "gram").distinct(), model)
        answers = asked.join(known, ["lang", "gram"]).select("block", "slot", "bits")
        texts = rows.mapInPandas(packed, "block string, rows binary")
        out = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(meet, "doc_id long, row long, lang string, n long, bits double")
        out = store(out, "kn-scores")
    drop(asked)
    return out


def _name(block: pd.DataFrame) -> str:
    """A block's name comes from its rows alone."""
    import hashlib

    h = hashlib.sha256()
    for doc_id, lang, text in zip(block["doc_id"], block["lang"], block["text"], strict=True):
        h.update(f"{doc_id}\0{lang}\0{len(text)}\0".encode())
        h.update(text.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


@small_batches
def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, tail: float = TAIL, margin: float = MARGIN, held_out: int = HELD_OUT) -> DataFrame:
    """doc_id, row (row_name() of doc_id and text), lang, n, perplexity, threshold, accepted for each row of docs.

    The model learns from documents that labels call good (quality 1) and not toxic, but for one in ``held_out`` by a
    hash of doc_id. The perplexity is per character. On the held-out documents, which the model has not seen, limits are
    taken: a language's is their median, plus the distance above it that ``tail`` of the held-out documents of all
    languages exceed, plus ``margin`` bits. So a few odd trusted documents don't open a small language's gate. Texts
    of n characters may be further above the mean by PRIOR_CHARS / n of the limit's own distance, since short texts scatter
    more; that is the threshold of a document. Documents beyond theirs are rejected.

    A null or empty text is scored as its end alone; a null language is a language of its own, apart from an empty
    one. Documents of a language without trusted text have null perplexity and threshold and are accepted, and so
    are those of a language without a held-out document, with a null threshold. Repeated rows are scored each; labels
    repeated for a document count once, as good if all say so. Empty tables reject nothing; other columns are ignored.
    """
    named = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    docs = docs.select("doc_id", row_name().alias("row"), named.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    good = labels.groupBy("doc_id").agg(F.min((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("ok")).where("ok AND doc_id IS NOT NULL").select("doc_id")
    good = store(good.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(held_out))), "kn-trusted")

    def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    few = small_enough(good, MOST_IDS)
    model = train(store(count_grams(among(docs, good.where("fold > 0").select("doc_id")), order), "kn-counts"), order)
    scores = score(docs, model, order)
    held = among(scores.where("bits IS NOT NULL"), good.where("fold = 0").select("doc_id"))
    means = held.groupBy("lang").agg((F.sum("bits") / F.sum("n")).alias("mean"))
    pulled = (F.col("bits") + PRIOR_CHARS * F.col("mean")) / (F.col("n") + PRIOR_CHARS)
    cells = held.join(means, "lang").select("lang", F.ceil(pulled * GRID).alias("cell"))
    medians = store(cells.groupBy("lang").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY cell)").alias("median")).join(means, "lang"), "kn-medians")
    near = F.broadcast(medians) if small_enough(medians, MOST_LANGS) else medians
    far = store(cells.join(near, "lang").select((F.col("cell") - F.col("median")).alias("far")), "kn-far")
    n = far.count()
    # Also of few documents the furthest does not set the limits.
    share = max(0.0, min(1 - tail, (n - 1.5) / n)) if n else 1.0
    spread = far.agg(F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY far)").alias("spread")).first()["spread"]
    limits = medians.select("lang", "mean", ((F.col("median") + F.lit(spread)) / GRID + margin).alias("limit"))
    per = F.col("bits") / F.col("n")
    most = F.col("limit") + PRIOR_CHARS * (F.col("limit") - F.col("mean")) / F.col("n")
    out = scores.join(F.broadcast(limits) if small_enough(medians, MOST_LANGS) else limits, "lang", "left")
    return out.select(
        "doc_id",
        "row",
        F.when(F.col("lang") != "", F.expr("substring(lang, 2)")).alias("lang"),
        "n",
        F.pow(F.lit(2.0), per).alias("perplexity"),
        F.when(most.isNotNull(), F.pow(F.lit(2.0), F.least(most, F.lit(1000.0)))).alias("threshold"),
        F.coalesce(per <= most, F.lit(True)).alias("accepted"),
    )
