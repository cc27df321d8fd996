"""Annotated tokens: mentions from BILOU tags and merging of annotations.

Tokens are rows (doc_id, sent, tok, surface, tag); a tag is O or entities
joined by a bar, each as letter-label.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MENTION = "doc_id string, sent long, start long, end long, label string, mention string"
TOKEN = "doc_id string, sent long, tok long, surface string, tag string"


def _tags(tag: str) -> list[tuple[str, str]]:
    return [] if tag in (None, "", "O") else [tuple(t.split("-", 1)) for t in tag.split("|") if "-" in t and "EG:" not in t]


def _found(rows: list[dict]) -> list[dict]:
    """Mentions of one sentence's tokens: U tags, and every B matched greedily with following I and an L of its label."""
    tags = [_tags(r["tag"]) for r in rows]
    used = [set() for _ in tags]
    out = []
    for i, here in enumerate(tags):
        for letter, label in here:
            end = i if letter == "U" else None
            if letter == "B":
                for j in range(i + 1, len(tags)):
                    free = [t for t in tags[j] if t[1] == label and t not in used[j]]
                    if ("L", label) in free:
                        used[j].add(("L", label))
                        end = j
                        break
                    if ("I", label) not in free:
                        break
                    used[j].add(("I", label))
            if end is not None:
                if rows[end]["tok"] - rows[i]["tok"] != end - i:
                    raise ValueError(f"mention over discontinuous tokens: {label} at {rows[i]['tok']}")
                out.append({"start": rows[i]["tok"], "end": rows[end]["tok"], "label": label, "mention": " ".join(r["surface"] for r in rows[i : end + 1])})
    return out


def _packed(spans: list[dict]) -> list[dict]:
    """Longest first, mentions of one sentence that overlap none kept before."""
    kept: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["start"] - s["end"], s["start"], s["label"])):
        if all(s["end"] < k["start"] or s["start"] > k["end"] for k in kept):
            kept.append(s)
    return kept


def _per_sentence(rows: DataFrame, fields: tuple[str, ...], work: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """``work`` on the sorted rows of every sentence, many sentences per Arrow batch."""
    out = pa.schema([("doc_id", pa.string()), ("sent", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("mention", pa.string())])

    def run(batches):
        for batch in batches:
            found = [{"doc_id": d, "sent": n} | m for d, n, r in zip(*(batch.column(i).to_pylist() for i in range(3))) for m in work(r)]
            yield pa.RecordBatch.from_pylist(found, schema=out)

    sentences = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id"), F.col("sent").cast("long").alias("sent")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("r"))
    return sentences.mapInArrow(run, MENTION)


def mentions(tokens: DataFrame) -> DataFrame:
    """(doc_id, sent, start, end, label, mention) with inclusive token positions; a sentence is one unit of work."""
    return _per_sentence(tokens, ("tok", "surface", "tag"), _found)


def single_label_mentions(tokens: DataFrame) -> DataFrame:
    """As ``mentions`` for tags of one entity each, in built-in expressions: a mention begins at B or U."""
    w = Window.partitionBy("doc_id", "sent").orderBy("tok")
    marked = tokens.withColumns({"letter": F.substring("tag", 1, 1), "label": F.substring_index("tag", "-", -1)})
    runs = marked.withColumn("run", F.count_if(F.col("letter").isin("B", "U", "O")).over(w)).where("tag != 'O'")
    words = F.array_sort(F.collect_list(F.struct("tok", "surface")))
    out = runs.groupBy("doc_id", "sent", "run").agg(F.min("tok").alias("start"), F.max("tok").alias("end"), F.first("label").alias("label"), words.alias("w"))
    return out.select("doc_id", "sent", "start", "end", "label", F.array_join(F.transform("w", lambda x: x["surface"]), " ").alias("mention"))


def span_union(*parts: DataFrame) -> DataFrame:
    """The mentions of several annotations of the same texts, without overlaps: longest first, then leftmost, then by label."""
    first, *others = parts
    for p in others:
        if p.columns != first.columns:
            raise ValueError("annotations need the same columns")
        first = first.unionByName(p)
    return _per_sentence(first.dropDuplicates(["doc_id", "sent", "start", "end", "label"]), ("start", "end", "label", "mention"), _packed)


def tagged(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """``tokens`` with tags re-written from non-overlapping mentions."""
    inner = found.select("doc_id", "sent", "start", "end", "label", F.explode(F.sequence("start", "end")).alias("tok"))
    letter = (
        F.when(F.col("start") == F.col("end"), "U").when(F.col("tok") == F.col("start"), "B").when(F.col("tok") == F.col("end"), "L").otherwise("I")
    )
    tags = inner.select("doc_id", "sent", "tok", F.concat_ws("-", letter, "label").alias("new_tag"))
    return tokens.join(tags, ["doc_id", "sent", "tok"], "left").withColumn("tag", F.coalesce("new_tag", F.lit("O"))).drop("new_tag")


def repaired_tags(tokens: DataFrame) -> DataFrame:
    """Tags cut by sentence ends: a B or I whose mention does not go on becomes U or L, an I or L that begins one B or U."""
    w = Window.partitionBy("doc_id", "sent").orderBy("tok")
    letter, label = F.substring("tag", 1, 1), F.substring_index("tag", "-", -1)
    marked = tokens.withColumns({"_l": letter, "_e": label})
    marked = marked.withColumns({"_p": F.lag(F.struct("_l", "_e")).over(w), "_n": F.lead(F.struct("_l", "_e")).over(w)})
    opened = F.coalesce(F.col("_p._l").isin("B", "I") & (F.col("_p._e") == F.col("_e")), F.lit(False))
    goes_on = F.coalesce(F.col("_n._l").isin("I", "L") & (F.col("_n._e") == F.col("_e")), F.lit(False))
    new = (
        F.when(F.col("_l").isin("B") & ~goes_on, "U").when((F.col("_l") == "I") & ~opened & ~goes_on, "U").when((F.col("_l") == "I") & ~opened, "B")
        .when((F.col("_l") == "I") & ~goes_on, "L").when((F.col("_l") == "L") & ~opened, "U").otherwise(F.col("_l"))
    )
    return marked.withColumn("tag", F.when(F.col("tag") == "O", "O").otherwise(F.concat_ws("-", new, "_e"))).drop("_l", "_e", "_p", "_n")


def plain_tags(tokens: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """Tags of other annotations in the form used here: an underscore or nothing as O, labels by ``renamed`` (such as KeyEntity to Entity)."""
    tag = F.when(F.coalesce("tag", F.lit("")).isin("", "_"), "O").otherwise(F.col("tag"))
    for old, new in (renamed or {}).items():
        tag = F.regexp_replace(tag, rf"(^|\|)([BILU])-{re.escape(old)}(?=\||$)", f"$1$2-{new}")
    return tokens.withColumn("tag", tag)
