"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document, in one pass of built-in expressions. The ledger keeps what was
measured and one failure bit per rule, and is stored (``stored``). Policies are named bit masks that are applied to the
stored bits afterwards (``judged``), and ablations are bitwise aggregates over them: no text is read again to try
another policy.

Defined results: a null or empty text has no words; ratios over no words or lines are 0, so it fails only
``no_words``. A null ``doc_id`` keeps its row. Repeated rows and ties are judged one by one. An empty table
gives an empty ledger. Extra columns of the input are ignored by ``ledger`` and kept by ``apply_policy``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.common import cut, pick, shielded, table

#: name, measurement, test of the measurement (SQL); the bit is the position.
RULES = [
    ("no_words", "n_words", "n_words = 0"),
    ("symbol_ratio", "symbol_ratio", "symbol_ratio > 0.5"),
    ("pipe_ratio", "pipe_ratio", "pipe_ratio > 0.3"),
    ("distinct_words", "distinct_ratio", "n_words >= 50 AND distinct_ratio < 0.15"),
    ("repeated_lines", "repeated_line_ratio", "n_lines >= 8 AND repeated_line_ratio > 0.7"),
    ("shouting", "upper_ratio", "n_words >= 5 AND upper_ratio > 0.6"),
    ("exclamations", "exclamation_ratio", "n_words >= 5 AND exclamation_ratio > 0.7"),
    ("word_length", "mean_word_length", "n_words >= 20 AND (mean_word_length < 2 OR mean_word_length > 15)"),
    ("few_words", "n_words", "n_words < 20"),
    ("few_letters", "mark_ratio", "mark_ratio > 0.3"),
    ("bullets", "bullet_line_ratio", "bullet_line_ratio > 0.9"),
    ("ellipses", "ellipsis_line_ratio", "ellipsis_line_ratio > 0.3"),
    ("braces", "n_braces", "n_braces > 20"),
    ("filler", "has_filler", "has_filler = 1"),
]
BIT = {name: 1 << i for i, (name, _, _) in enumerate(RULES)}

#: Versioned policies: a document is rejected if it fails a rule of the mask. v2 drops the rules of v1 that
#: reject labelled good documents (short texts, texts with many marks between the words).
POLICIES = {
    "v1": sum(BIT.values()),
    "v2": sum(BIT[r] for r in ("symbol_ratio", "pipe_ratio", "distinct_words", "shouting", "exclamations", "word_length", "bullets", "ellipses", "filler")),
}
CURRENT = "v2"

LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ſ"
#: Strings that are counted without overlap: the text shrinks by their length where they are replaced by nothing.
REPLACED = {"n_symbols": ["#", "$", "%", "&", "*"], "n_pipes": ["|"], "n_exclamations": ["!!"], "n_braces": ["{", "}"], "n_breaks": ["\n"], "n_white": [" ", "\n", "\t", "\r"]}
SCANNED = {"n_upper": "[A-ZÀ-ÖØ-Þ]", "n_marks": f"[^{LETTER} \\t\\n\\r]"}
COUNTS = [*REPLACED, *SCANNED, "n_chars", "n_words", "n_distinct", "n_distinct_lines", "n_bullets", "n_ellipses", "has_filler"]
MEASURES = {
    "n_words": "n_words",
    "n_lines": "n_breaks + 1",
    "symbol_ratio": "n_symbols / n_words",
    "pipe_ratio": "n_pipes / n_words",
    "distinct_ratio": "n_distinct / n_words",
    "repeated_line_ratio": "(n_breaks + 1 - n_distinct_lines) / (n_breaks + 1)",
    "upper_ratio": "n_upper / (n_chars - n_white)",
    "exclamation_ratio": "n_exclamations / n_words",
    "mean_word_length": "(n_chars - n_white) / n_words",
    "mark_ratio": "n_marks / (n_chars - n_white)",
    "bullet_line_ratio": "n_bullets / (n_breaks + 1)",
    "ellipsis_line_ratio": "n_ellipses / (n_breaks + 1)",
    "n_braces": "n_braces",
    "has_filler": "has_filler",
}


def _counts(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Counts of one text; splits and plain replacements stay cheap, and two short patterns scan for characters."""

    def replaced(parts: list[str]) -> Column:
        out = F.lit(0)
        for p in parts:
            out = out + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
        return out.cast("long")

    return {
        **{k: replaced(v) for k, v in REPLACED.items()},
        **{k: F.regexp_count(text, F.lit(p)) for k, p in SCANNED.items()},
        "n_chars": F.length(text),
        "n_words": F.size(words),
        "n_distinct": F.size(F.array_distinct(words)),
        "n_distinct_lines": F.size(F.array_distinct(lines)),
        "n_bullets": F.size(F.filter(lines, lambda x: x.rlike("^ *[-*•]"))),
        "n_ellipses": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
        "has_filler": F.when(text.contains("lorem ipsum") | text.contains("Lorem ipsum"), 1).otherwise(0),
    }


def _ratio(expression: str) -> str:
    """Ratios as doubles, 0 over nothing, rounded to 6 places (the ledger's precision)."""
    if " / " not in expression:
        return expression
    over, under = expression.split(" / ")
    return f"CASE WHEN {under} = 0 THEN CAST(0 AS DOUBLE) ELSE round(CAST({over} AS DOUBLE) / {under}, 6) END"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add a column ``__q_<measurement>`` for every measurement.

    Each step is its own projection: an expression that later ones use repeatedly is then evaluated once.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    split = docs.withColumns({"__t": text})
    split = split.withColumns({"__w": F.array_remove(F.split("__t", "[ \\t\\n\\r]+", -1), ""), "__l": F.split("__t", "\\n", -1)})
    counts = split.withColumns({f"__c_{k}": c.cast("long") for k, c in _counts(F.col("__t"), F.col("__w"), F.col("__l")).items()})
    done = counts.withColumns({f"__q_{k}": F.expr(_renamed(_ratio(e), COUNTS, "__c_")) for k, e in MEASURES.items()})
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], *[f"__q_{k}" for k in MEASURES])


def _renamed(sql: str, names, prefix: str) -> str:
    return re.sub(r"\b\w+\b", lambda m: prefix + m[0] if m[0] in names else m[0], sql)


def _bits(prefix: str = "") -> str:
    return " + ".join(f"(CASE WHEN {_renamed(sql, MEASURES, prefix)} THEN {BIT[name]} ELSE 0 END)" for name, _, sql in RULES)


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policies: dict[str, int] = POLICIES) -> DataFrame:
    """One row per document: id, measurements, ``fail_bits``, and ``keep_<policy>`` for each policy."""
    m = measured(pick(docs, doc_id=id_col, text=text_col))
    led = m.select("doc_id", *[F.col(f"__q_{k}").alias(k) for k in MEASURES]).withColumn("fail_bits", F.expr(_bits()).cast("long"))
    return judged(led, policies)


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger before any policy, written once and read back: what follows reads its numbers, not the texts."""
    return cut(ledger(docs, id_col, text_col, {}), "ledger")


def judged(led: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """A ledger with ``keep_<policy>`` for each policy, from its failure bits alone."""
    return led.withColumns({f"keep_{p}": F.expr(f"(fail_bits & {mask}) = 0") for p, mask in policies.items()})


def ablations(led: DataFrame, policies: dict[str, int] = POLICIES) -> DataFrame:
    """Per policy and rule of it: failures, rejections by this rule alone, and kept documents if it were dropped.

    Works on ``fail_bits`` alone: documents are first counted per distinct mask, so the second step is tiny.
    """
    spark = led.sparkSession
    masks = led.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rows = [(p, name, mask, BIT[name]) for p, mask in policies.items() for name in BIT if mask & BIT[name]]
    rules = spark.createDataFrame(rows, "policy string, rule string, mask long, bit long")
    hit = F.expr("fail_bits & mask")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0)).cast("long")
    return (
        rules.join(masks, how="left")
        .groupBy("policy", "rule")
        .agg(
            s(F.expr("fail_bits & bit") != 0).alias("n_fail"),
            s(hit == F.col("bit")).alias("n_only"),
            s((F.col("fail_bits").isNotNull()) & (hit == 0)).alias("n_kept"),
            s((F.col("fail_bits").isNotNull()) & (F.expr("fail_bits & (mask & ~bit)") == 0)).alias("n_kept_without"),
            F.coalesce(F.bit_or("fail_bits"), F.lit(0)).alias("bits_seen"),
        )
    )


def apply_policy(docs: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """Keep the documents that pass a policy; columns as they came."""
    plain, new = shielded(docs)
    keep = measured(plain, new[text_col]).withColumn("__bits", F.expr(_bits("__q_")).cast("long"))
    return keep.filter(F.expr(f"(__bits & {POLICIES[policy]}) = 0")).select(*new.values()).toDF(*docs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger with the policies' verdicts; ``ablations`` works on it as it is."""
    return judged(stored(table(spark, sf_dir, "documents")))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored ledger: the texts are measured once, what is done with the bits afterwards reads these."""
    return ablations(stored(table(spark, sf_dir, "documents")))


def _duck_counts() -> str:
    q = lambda p: "'" + p.replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r") + "'"
    replaced = {k: " + ".join(f"(strlen(text) - strlen(replace(text, {q(p)}, ''))) // {len(p)}" for p in v) for k, v in REPLACED.items()}
    counts = {
        **replaced,
        **{k: f"len(regexp_extract_all(text, {q(p)}))" for k, p in SCANNED.items()},
        "n_chars": "length(text)",
        "n_words": "len(w)",
        "n_distinct": "len(list_distinct(w))",
        "n_distinct_lines": "len(list_distinct(l))",
        "n_bullets": "len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]')))",
        "n_ellipses": "len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…'))",
        "has_filler": "CASE WHEN contains(text, 'lorem ipsum') OR contains(text, 'Lorem ipsum') THEN 1 ELSE 0 END",
    }
    return (
        f"SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in counts.items())} FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l, "
        f"regexp_extract_all(text, {q('[^ \\t\\n\\r]+')}) AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))"
    )


LEDGER_SQL = (
    f"WITH c AS ({_duck_counts()}), m AS (SELECT doc_id, " + ", ".join(f"{_ratio(e)} AS {k}" for k, e in MEASURES.items()) + " FROM c), "
    f"b AS (SELECT *, CAST({_bits()} AS BIGINT) AS fail_bits FROM m) "
    "SELECT *, " + ", ".join(f"(fail_bits & {mask}) = 0 AS keep_{p}" for p, mask in POLICIES.items()) + " FROM b"
)
ABLATION_SQL = (
    f"WITH led AS ({LEDGER_SQL}), r(policy, rule, mask, bit) AS (VALUES "
    + ", ".join(f"('{p}', '{n}', {mask}, {BIT[n]})" for p, mask in POLICIES.items() for n in BIT if mask & BIT[n])
    + ") SELECT policy, rule, CAST(count(*) FILTER ((fail_bits & bit) <> 0) AS BIGINT) AS n_fail, "
    "CAST(count(*) FILTER ((fail_bits & mask) = bit) AS BIGINT) AS n_only, CAST(count(*) FILTER ((fail_bits & mask) = 0) AS BIGINT) AS n_kept, "
    "CAST(count(*) FILTER ((fail_bits & (mask & ~bit)) = 0) AS BIGINT) AS n_kept_without, bit_or(fail_bits) AS bits_seen FROM led, r GROUP BY ALL"
)
