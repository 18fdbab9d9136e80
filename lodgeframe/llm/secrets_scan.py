"""Secret scans with a trigram inverted index.

From each rule's regex follows a Boolean query over trigrams. The index holds, for every trigram that any
query needs, the documents whose text has it (the text in lower case). Postings are intersected per alternative
of a query and only the documents that are left are verified with the regex itself; rules whose
query says nothing are tried on every text. All of it is SQL functions and joins; of the texts, only those of
candidates that a filter cannot clear are shuffled.

Cases: a null text counts as empty and has no secrets. Texts of any length are scanned whole; offsets are code
points. Rows that repeat id and text get the same answer. Empty tables give empty results; further columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodgeframe.llm.bloom import bitmaps, filter_blocks, tested
from lodgeframe.llm.spans import match_spans
from lodgeframe.llm.storage import stored
from lodgeframe.llm.trigrams import ALL, trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches whose group has fewer than ``least`` characters do not count."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: The base rules (fixed values) and those that this operator adds.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
]
ADDED = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"(?:sk|rk)_live_[0-9A-Za-z]{16,}"),
    Rule("package_token", r"npm_[A-Za-z0-9]{36}"),
    Rule("mail_key", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)bearer +[a-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s/:@]{1,64}:[^\s/:@]{3,64}@"),
]
RULES = [*BASE, *ADDED]


def _doc(key: str, text: str) -> Column:
    return F.xxhash64(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")))


def clauses(rules: list[Rule]) -> list[tuple[str, int, str, int]]:
    """(kind, alternative, trigram, trigrams of the alternative) of the rules whose query says something."""
    out = []
    for rule in rules:
        if (query := trigram_query(rule.regex)) != ALL:
            for k, alternative in enumerate(sorted(map(sorted, query))):
                out += [(rule.kind, k, trigram, len(alternative)) for trigram in alternative]
    return out


def build_index(df: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings (trigram, doc) of the trigrams that the rules' queries name."""
    needed = sorted({trigram for _, _, trigram, _ in clauses(rules)})
    lower = df.select(_doc(key, text).alias("doc"), F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_lower"))
    present = F.filter(F.array(*map(F.lit, needed)), lambda t: F.contains(F.col("_lower"), t))
    return lower.select(F.explode(present).alias("trigram"), "doc")


def candidates(index: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc, kinds): the rules whose trigram query the document's postings satisfy."""
    spark = index.sparkSession
    wanted = spark.createDataFrame(clauses(rules), "kind string, alternative int, trigram string, size int")
    # As many rows as the rules name: fixed by the rules.
    hits = index.distinct().join(F.broadcast(wanted), "trigram").groupBy("doc", "kind", "alternative", "size").count()
    return hits.where("count = size").groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule) -> Column:
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    spans = match_spans(text, F.lit(rule.regex), found)
    if rule.least:
        sized = found if not rule.group else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
        both = F.arrays_zip(spans.alias("span"), sized.alias("sized"))
        kept = F.filter(both, lambda x: F.char_length(x["sized"]) >= rule.least)
        spans = F.transform(kept, lambda x: x["span"])
    return spans


def scan(df: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with _secrets array<struct<start,order,end,kind>>: by place, then in the order of the rules."""
    if clash := {"_doc", "_kinds", "_text", "_h", "_block", "_bitmap", "_secrets"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are used by this operator")
    rules = RULES if rules is None else rules
    indexed = {kind for kind, *_ in clauses(rules)}
    own = [f"`{c}`" for c in df.columns]
    index = stored(build_index(df, rules, key, text), "postings")
    found = stored(candidates(index, rules), "candidates")
    blocks = filter_blocks(found.select(F.lit(1)).count())
    table = bitmaps(found.select(F.xxhash64("doc").alias("h")), blocks)
    marked, possible = tested(df.withColumn("_doc", _doc(key, text)), F.xxhash64("_doc"), table, blocks)

    kind = "array<struct<start:int,order:int,end:int,kind:string>>"

    def verified(rows: DataFrame, tried: list[Rule]) -> DataFrame:
        whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))

        def spans(order: int, rule: Rule) -> Column:
            tests = [F.rlike(whole, F.lit(rule.regex))]
            if rule.kind in indexed:
                tests.insert(0, F.array_contains("_kinds", rule.kind))
            made = F.transform(
                _spans(whole, rule),
                lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(rule.kind).alias("kind")),
            )
            return F.when(reduce(and_, tests), made).otherwise(F.array().cast(kind))

        parts = [spans(k, r) for k, r in enumerate(rules) if r in tried]
        every = F.sort_array(F.concat(*parts)) if parts else F.array().cast(kind)
        return rows.select(*own, every.alias("_secrets"))

    cleared = verified(marked.where(~possible), [r for r in rules if r.kind not in indexed])
    named = found.select(F.col("doc").alias("_doc"), F.col("kinds").alias("_kinds"))
    rest = marked.where(possible).select(*own, "_doc").join(named, "_doc", "left")
    rest = rest.withColumn("_kinds", F.coalesce("_kinds", F.array().cast("array<string>")))
    return cleared.unionByName(verified(rest, rules))
