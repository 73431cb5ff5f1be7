"""Token labels: BIO to spans and back, chunk scores, position-aligned scores.

Token frames have doc_id, pos, token and label columns.  Windows run within documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.metrics import precision, ratio, recall
from glossa.operators.sweep import best_of, by_document, codes, kinds, meeting, numbers, swept


def with_offsets(tokens: DataFrame, base: int = 0) -> DataFrame:
    """Adds start and end of each token in the text that single blanks join."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(F.length("token") + 1).over(w), F.lit(0)) + base).cast("long")
    return tokens.withColumn("start", start).withColumn("end", F.col("start") + F.length("token"))


def spans_of(tokens: DataFrame, label: str = "label", base: int = 0) -> DataFrame:
    """doc_id, start, end, tag, text: B- opens, I- extends whatever is open, an I- with nothing open is ignored."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.substring(label, 1, 2)
    rows = with_offsets(tokens, base).withColumn("begins", (kind == "B-").cast("int")).withColumn("stops", (~kind.isin("B-", "I-")).cast("int"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("island", F.sum("begins").over(upto)).withColumn("gap", F.sum("stops").over(upto))
    # the span is the run of its island before the island's first stop
    own = Window.partitionBy("doc_id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.where("island > 0").withColumn("broken", F.sum("stops").over(own)).where("broken = 0")
    tag = F.min_by(F.substring(label, 3, 1 << 20), "pos")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ")
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), tag.alias("tag"), text.alias("text")).drop("island")


def labels_of(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """Adds label: B- or I- and the tag of the span that holds the token (the first to start), else O.  Needs start and end."""
    columns = tokens.columns

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side = table.column("_side").to_numpy()
        t, s = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        start, end, first, last = numbers(table, "start", "end", "_from", "_to")
        tags = table.column("_tag").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort([x.encode() for x in tags.dictionary.to_pylist()])) if len(tags.dictionary) else np.zeros(1, np.int64)
        tag = pc.fill_null(tags.indices, 0).to_numpy(zero_copy_only=False)
        held = np.full(len(side), -1, np.int64)
        for i, j in meeting((document[t], start[t], end[t]), (document[s], first[s], last[s])):
            i, j = t[i], s[j]
            inside = (first[j] <= start[i]) & (end[i] <= last[j])
            i, j = i[inside], j[inside]
            known = np.flatnonzero(held[i] >= 0)  # pairs come in pieces: the best so far takes part
            i, j = np.append(i, i[known]), np.append(j, held[i[known]])
            best = best_of(i, first[j], last[j], rank[tag[j]])
            held[i[best]] = j[best]
        own = held[t]
        begins = np.where(own < 0, 0, np.where(first[own] == start[t], 1, 2))
        mark = pa.array(["O", "B-", "I-"]).take(pa.array(begins))
        label = pc.binary_join_element_wise(mark, pc.fill_null(table.column("_tag").combine_chunks().take(pa.array(own, mask=own < 0)), ""), "")
        yield pa.table([*(table.column(c).take(pa.array(t)) for c in columns), label], names=[*columns, "label"])

    right = spans.dropna(subset=["doc_id", "tag"]).select("doc_id", F.col("start").alias("_from"), F.col("end").alias("_to"), F.col("tag").alias("_tag"))
    return swept(tokens, right, ["doc_id"], work, ", ".join([*kinds(tokens, columns), "label string"]), together=True)


#: Marks of chunk labels; what else stands before a hyphen counts as another mark.
MARKS = "BIEO.[]"
_OTHER = len(MARKS)
#: Pairs of marks (before, now) between which a chunk ends, and at whose second one starts; a change of type does either, too.
_ENDS = ["BB", "BO", "IB", "IO", "EE", "EI", "EO"]
_STARTS = ["BB", "IB", "OB", "EE", "EI", "OE", "OI"]


def _table(pairs: list[str]) -> np.ndarray:
    out = np.zeros((_OTHER + 1, _OTHER + 1), bool)
    for before, now in pairs:
        out[MARKS.index(before), MARKS.index(now)] = True
    return out


def _series(column: pa.ChunkedArray, order: np.ndarray, first: np.ndarray, types: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token in order: does a chunk start, does one end before it, and the number of its type.

    A label is `MARK-TYPE`, parted at its first hyphen; without one the type is empty.  A
    null label is O, and so is what stands before a document (whose tokens `first` marks).
    """
    labels = pc.fill_null(column.combine_chunks(), "O").dictionary_encode()
    parts = [x.partition("-") for x in labels.dictionary.to_pylist()]
    marks = np.array([MARKS.index(m) if m and m in MARKS else _OTHER for m, _, _ in parts] or [0])
    kinds_ = np.array([types.setdefault(t, len(types)) for _, _, t in parts] or [0])
    at = labels.indices.to_numpy(zero_copy_only=False)[order]
    mark, kind = marks[at], kinds_[at]
    before = np.where(first, MARKS.index("O"), np.roll(mark, 1))
    changed = np.where(first, types.setdefault("", len(types)), np.roll(kind, 1)) != kind
    is_ = lambda m, some: np.isin(m, [MARKS.index(x) for x in some])
    ends = _table(_ENDS)[before, mark] | is_(before, "[]") | (~is_(before, "O.") & changed)
    starts = _table(_STARTS)[before, mark] | is_(mark, "[]") | (~is_(mark, "O.") & changed)
    return starts, ends, kind


def _in_order(table: pa.Table, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the tokens, each one's document, and whether it is its document's first."""
    order = np.lexsort((table.column("pos").to_numpy(), document))
    document = document[order]
    return order, document, np.concatenate([[True], document[1:] != document[:-1]])


def _chunks(tokens: DataFrame, labels: list[str]) -> DataFrame:
    """doc_id, side (a label column), first, last, type of each chunk: one shuffle, whatever the number of label columns."""

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        order, document, new = _in_order(table, document)
        pos = table.column("pos").take(pa.array(order))
        for label in labels:
            types: dict[str, int] = {}
            starts, ends, kind = _series(table.column(label), order, new, types)
            at = np.flatnonzero(starts)
            # a chunk lasts until something starts or ends, or the document does
            stops = np.append(np.flatnonzero(starts | ends | new), len(order))
            last = stops[np.searchsorted(stops, at, "right")] - 1
            names = pa.array(list(types), pa.string())
            docs = table.column("doc_id").take(pa.array(order[at]))
            yield pa.table([docs, pa.array([label] * len(at), pa.string()), pos.take(pa.array(at)), pos.take(pa.array(last)), names.take(pa.array(kind[at]))], names=["doc_id", "side", "first", "last", "type"])

    kind = tokens.schema["pos"].dataType.simpleString()
    return by_document(tokens.select("doc_id", "pos", *labels), ["doc_id"], work, ", ".join([*kinds(tokens, ["doc_id"]), f"side string, first {kind}, last {kind}, type string"]))


def chunks(tokens: DataFrame, label: str) -> DataFrame:
    """doc_id, first, last, type of each chunk."""
    return _chunks(tokens, [label]).drop("side")


def token_accuracy(tokens: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """n_tokens and accuracy: percent of tokens whose whole labels are equal."""
    same = F.avg((F.col(gold) == F.col(pred)).cast("double"))
    return tokens.agg(F.count(F.lit(1)).alias("n_tokens"), F.round(100 * F.coalesce(same, F.lit(0.0)), 2).alias("accuracy"))


def chunk_counts(tokens: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """type, n_gold, n_found, n_correct, to be added up: chunks that start in each series, and those that both have.

    Both series are walked together.  Where a chunk of the same type starts in both, it is
    open; the first token after which a chunk ends in either, or types differ, closes it,
    and it is correct if both end there.  So also series are compared whose chunks start
    before others end (marks [ and ]), which have no chunks to be joined by their places.
    """

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        order, document, new = _in_order(table, document)
        types: dict[str, int] = {}
        g_starts, g_ends, g = _series(table.column(gold), order, new, types)
        p_starts, p_ends, p = _series(table.column(pred), order, new, types)
        opens = np.flatnonzero(g_starts & p_starts & (g == p))
        # what closes: before a token; a document's end closes, too, and counts as the end of both
        closes = np.flatnonzero((g_ends | p_ends | (g != p) | new)[1:]) + 1
        right = (new | (g_ends & p_ends))[closes]
        closes, right = np.append(closes, len(order)), np.append(right, True)
        # tokens that open something before the same close open one chunk
        last = np.unique(np.searchsorted(closes, opens, "right"))
        last = last[right[last]]
        n = len(types)
        count = lambda x: np.bincount(x, minlength=n)
        yield pa.table([pa.array(list(types), pa.string()), count(g[g_starts]), count(p[p_starts]), count(g[closes[last] - 1])], names=["type", "n_gold", "n_found", "n_correct"])

    return by_document(tokens.select("doc_id", "pos", gold, pred), ["doc_id"], work, "type string, n_gold long, n_found long, n_correct long")


def chunk_scores(tokens: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """type (null for all), n_gold, n_found, n_correct and percentages: precision, recall, f1, of whole chunks."""
    counts = chunk_counts(tokens, gold, pred).where("n_gold + n_found > 0").rollup("type").agg(*(F.sum(c).alias(c) for c in ("n_gold", "n_found", "n_correct")))
    p = precision(F.col("n_correct"), F.col("n_found") - F.col("n_correct"))
    r = recall(F.col("n_correct"), F.col("n_gold") - F.col("n_correct"))
    f = ratio(2 * p * r, p + r)
    return counts.select("type", "n_gold", "n_found", "n_correct", *(F.round(100 * x, 2).alias(n) for x, n in ((p, "precision"), (r, "recall"), (f, "f1"))))


def overall_and_last(scores: DataFrame) -> DataFrame:
    """One row of chunk_scores: precision, recall and f1 of all chunks, and legacy_last_type with its three.

    A reader of printed reports took the line that came last, so the scores of the type that
    sorts last, for those of all; they stand beside them for comparison with its output.
    """
    names = ("precision", "recall", "f1")
    overall = [F.max(F.when(F.col("type").isNull(), F.col(c))).alias(c) for c in names]
    last = F.max(F.when(F.col("type").isNotNull(), F.struct("type", *names)))
    return scores.agg(*overall, last.alias("last")).select(*names, F.col("last.type").alias("legacy_last_type"), *(F.col(f"last.{c}").alias(f"legacy_{c}") for c in names))


def aligned_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Position by position: doc_id, pos, gold, pred.  Different tokens count as agreement on O, missing ones as O.

    Both sides meet by document, so what is made of a document's pairs next is in one place.
    """
    kind = gold.schema["pos"].dataType

    def work(table: pa.Table, document: np.ndarray) -> Iterator[pa.Table]:
        side, pos, token = table.column("_side").to_numpy(), codes(table.column("pos")), codes(table.column("token"))
        key = np.where(pc.is_valid(table.column("doc_id")).to_numpy(), document * (int(pos.max(initial=0)) + 1) + pos, -1)
        key[pos < 0] = -1  # without a place, or a document, nothing has a partner
        g, p = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        p = p[np.argsort(key[p], kind="stable")]
        first = np.searchsorted(key[p], key[g], "left")
        n = np.where(key[g] < 0, 0, np.searchsorted(key[p], key[g], "right") - first)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        lone, other = g[n == 0], np.delete(p, at)
        i, j = np.concatenate([np.repeat(g, n), lone, other]), np.concatenate([p[at], lone, other])
        met = np.arange(len(i)) < len(at)
        same = np.where(met, token[i] == token[j], token[i] < 0)
        label = lambda name, rows: pc.if_else(pa.array(same), table.column(name).combine_chunks().take(pa.array(rows)), "O")
        yield pa.table([table.column("doc_id").take(pa.array(i)), table.column("pos").take(pa.array(i)), label("gold", i), label("pred", j)], names=["doc_id", "pos", "gold", "pred"])

    side = lambda df, name: df.select("doc_id", F.col("pos").cast(kind).alias("pos"), "token", F.col("label").alias(name))
    return swept(side(gold, "gold"), side(pred, "pred"), ["doc_id"], work, ", ".join([*kinds(gold, ["doc_id", "pos"]), "gold string", "pred string"]), together=True)


def paired_lines(gold: DataFrame, pred: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Lines of both sides by their order (key, pos, token, gold, pred), and the files that fail (key, n_gold, n_pred, error).

    A predicted file fails if there is no gold file of its name, or if the numbers of
    lines differ; its lines are not paired.  Gold files without a prediction are ignored.
    """
    g = gold.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold"))
    p = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n_pred"))
    sizes = p.join(g, key, "left")
    error = F.when(F.col("n_gold").isNull(), "no gold").when(F.col("n_gold") != F.col("n_pred"), "line count")
    sizes = sizes.withColumn("error", error)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1
    # one shuffle: both sides and the sizes are dealt by the file
    rows = gold.select(key, nth.alias("pos"), "token", F.col("label").alias("gold")).join(pred.select(key, nth.alias("pos"), F.col("label").alias("pred")), [key, "pos"])
    return rows.join(sizes.where("error is null").select(key), key, "left_semi"), sizes.where("error is not null")


def aligned_accuracy(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of equal labels, O included: micro precision, recall and F over all labels alike."""
    return pairs.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))
