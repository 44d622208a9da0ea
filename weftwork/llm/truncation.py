"""Replies that were cut off before their end.

A reply is read as an optional preamble, a graph in JSON and an optional closing
remark; marks that are put after a cut are set aside. Each part gives a value to
look for elsewhere: preambles and remarks as they are, JSON as its skeleton, in which
every scalar is one mark and runs of equal list items are one item, so that replies
of one style share their skeletons whatever they say.

A self-join by prefix shows cuts: all distinct values are sorted, and a value has a
longer copy exactly if the next value in order starts with it. The part that stands
last in a reply counts as cut if it has a longer copy and, for JSON, does not close.
JSON that never closes counts as cut also without a longer copy, as its own column
``open`` says, since few cut replies have a twin. The sort is by range over distinct
values; neighbours across partition borders are compared through the first value of
each partition. Every reply is read once; what was read is written before it is joined.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.operators.repair import first_bracket, scan
from weftwork.session import cut_lineage, spread, written

#: What is put behind a cut: blanks, lost characters, ellipses, one word in brackets that is no value.
_MARKS = re.compile(r"(?:\s|�|…|\.\.\.|\[(?!(?:null|true|false)\])[a-z]{3,20}\])+$")
_FENCE_END = re.compile(r"\s*```\s*$")
#: What JSON goes on with behind a bracket.
_GOES_ON = (",", ":", '"', "'", "{", "[")
_BODY_END = re.compile(r"[\"'}\[,]\s*\]\s*\}")


#: A string, closed or not; any other scalar; blanks.
_SCALAR = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"?|[^\s"{}\[\]:,]+', re.DOTALL)
_BLANKS = re.compile(r"\s+")
_RUN = re.compile(r"(\{[^{}]*\},)\1+")


def skeleton(text: str) -> str:
    """JSON without blanks, each scalar as one mark, runs of list items of one shape as one item."""
    return _RUN.sub(r"\1", _BLANKS.sub("", _SCALAR.sub("s", text)))


def ending(raw: str) -> tuple[str, str, str, str]:
    """(state, head, JSON skeleton, remark) of a reply; parts it does not have are ''.

    States name what stands last: ``ended`` JSON; ``prose`` without any JSON;
    ``remark`` behind JSON; ``open`` where JSON or a code fence never closes, or a
    cut mark follows what had ended.
    """
    text = raw.strip()
    core = _MARKS.sub("", text)
    marked = len(core) < len(text)
    at = first_bracket(core)
    if at < 0:
        core = _FENCE_END.sub("", core) if "\n" in core else core
        if core.startswith("```"):
            return "open", core, "", ""
        if not core:
            return "open" if marked else "ended", "", "", ""
        if not marked and (core in ("null", "true", "false") or re.fullmatch(r'"[^"]*"|-?[\d.]+', core)):
            return "ended", core, "", ""
        return "prose", core, "", ""
    head = core[: at + 1]
    fenced = "```" in head
    end = scan(core, at)[0]
    rest = core[end:].lstrip(" \t\r\n}]") if end > 0 else ""
    if end < 0 or rest[:1] in _GOES_ON:
        ends = [m.end() for m in _BODY_END.finditer(core, at)]  # ill-formed: look for where the lists close
        rest = core[ends[-1] :].lstrip(" \t\r\n}]") if ends else ""
        if not ends or rest[:1] in _GOES_ON:
            return "open", head, skeleton(_FENCE_END.sub("", core)[at:]), ""
        end = ends[-1]
    body = skeleton(core[at:end])
    if fenced:
        if not rest.startswith("```"):
            return "open", head, body, ""
        rest = rest[3:]
    rest = _FENCE_END.sub("", rest).strip() if not fenced else rest.strip().removesuffix("```").strip()
    if rest:
        return "remark", head, body, rest
    return ("open" if marked else "ended"), head, body, ""


def prefixes_of_longer(values: DataFrame) -> DataFrame:
    """``kind, value_id`` of values (``kind``, ``value``) that are strict prefixes of a longer value of their kind.

    ``value_id`` is the MD5 of the value. Null and empty values are left out.
    """
    spark = values.sparkSession
    ordered = (
        values.where("value is not null and value <> ''")
        .groupBy("kind", "value")
        .agg(F.lit(1).alias("one"))
        .select("kind", "value")
        .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "kind", "value")
        .sortWithinPartitions("kind", "value")
    )
    ordered = cut_lineage(ordered).withColumn("part", F.spark_partition_id())
    firsts = ordered.groupBy("part").agg(F.min(F.struct("kind", "value")).alias("first")).orderBy("part").collect()  # one row a partition
    following = {a["part"]: (b["first"]["kind"], b["first"]["value"]) for a, b in zip(firsts, firsts[1:], strict=False)}
    shared = spark.sparkContext.broadcast(following)

    def scan(batches):
        last = None
        for batch in batches:
            hits = []
            for row in zip(batch["kind"], batch["value"], batch["part"], strict=True):
                if last is not None and last[0] == row[0] and row[1].startswith(last[1]):
                    hits.append(last[:2])
                last = row
            yield pd.DataFrame(hits, columns=["kind", "value"])
        if last is not None:
            after = shared.value.get(last[2])
            if after and after[0] == last[0] and after[1].startswith(last[1]):
                yield pd.DataFrame([last[:2]], columns=["kind", "value"])

    return ordered.mapInPandas(scan, "kind string, value string").select("kind", F.md5("value").alias("value_id"))


#: The part that decides in each state.
_LAST = {"prose": "head", "remark": "remark", "open": "json"}


def endings(replies: DataFrame) -> DataFrame:
    """``graph_id, attempt, provider, model, state, head, json, remark``; null ``raw`` is left out.

    Numbers in remarks are written as 0, so that counts do not make them different.
    """

    @F.pandas_udf("state string, head string, json string, remark string")
    def read(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ending(r) for r in raw], columns=["state", "head", "json", "remark"])

    rows = spread(replies.select("graph_id", "attempt", "provider", "model", "raw").where("raw is not null")).withColumn("e", read("raw"))
    return rows.select("graph_id", "attempt", "provider", "model", "e.state", "e.head", "e.json", F.regexp_replace("e.remark", "[0-9]+", "0").alias("remark"))


def cut_replies(replies: DataFrame) -> DataFrame:
    """``graph_id, attempt, provider, model, cut, by, open``: every reply with a text, whether it was cut and what shows it.

    ``by`` is ``prefix`` where a longer copy of its last part exists, ``open`` where
    its JSON or fence never ended and no longer copy exists, else null; ``open`` says
    that it never ended, with a longer copy or without. A reply delivered twice appears
    twice.
    """
    rows = written(endings(replies), "endings")
    parts = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("head", "json", "remark")))
    longer = prefixes_of_longer(rows.select(F.explode(parts).alias("p")).select("p.kind", "p.value"))
    last = F.create_map(*(F.lit(x) for pair in _LAST.items() for x in pair))[F.col("state")]
    value = F.coalesce(*(F.when(F.col("kind") == k, F.col(k)) for k in ("head", "json", "remark")))
    asked = rows.withColumn("kind", last).withColumn("value_id", F.md5(value)).drop("head", "json", "remark")
    judged = asked.join(longer.withColumn("hit", F.lit(True)), ["kind", "value_id"], "left")
    by = F.when(F.col("hit"), "prefix").when(F.col("state") == "open", "open")
    return judged.withColumn("by", by).select("graph_id", "attempt", "provider", "model", F.col("by").isNotNull().alias("cut"), "by", (F.col("state") == "open").alias("open"))


def cut_report(judged: DataFrame) -> DataFrame:
    """``provider, model, n_replies, n_cut, n_by_prefix, n_only_prefix``: how often each source truncates.

    ``n_by_prefix`` have a longer copy, ``n_only_prefix`` nothing else that shows the cut.
    """
    hit = F.col("by") == "prefix"
    return judged.groupBy("provider", "model").agg(
        F.count("*").alias("n_replies"), F.count_if("cut").alias("n_cut"), F.count_if(hit).alias("n_by_prefix"), F.count_if(hit & ~F.col("open")).alias("n_only_prefix")
    )
