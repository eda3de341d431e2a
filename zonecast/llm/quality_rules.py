"""Quality rules per document and per host (native): DataFrame functions only.

A document fails the base rules if it has fewer than ten words or if over 20 % of its words lie in five-word windows that
the text holds twice or more. Failures of these and of the other `RULES` are added up by host, each rule by itself. A host's rate of a
rule is shrunk towards the rate of all documents by a beta prior, whose strength follows from how much the hosts' rates differ beyond what
chance gives hosts of their size (the moments of a beta-binomial), so a host with few documents, or any host where hosts hardly differ, is
judged by the prior. A host whose shrunk rate passes `RATIO` times the rate of all documents (but at least `FLOOR`, and halfway
to 1 where failures are common) in any rule is rejected with all its documents.

Defined results: null and empty texts have no words and fail; a null host is no host, its documents are judged by the base rules
alone; repeated rows count each; an empty table gives an empty result; other columns of the input are left out of the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonecast.llm.common import SPACES, restored, split_words
from zonecast.session import materialize

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
SYMBOLS = "#*$%&|<>"
#: A host is rejected when a rule fails there so many times as often as everywhere, from this rate on.
RATIO, FLOOR = 3.0, 0.3
#: Rules by name, over the statistics of a document.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
#: Prior weight, in documents, where hosts do not differ more than chance allows.
MAX_STRENGTH = 10_000.0


def _repeated(hashes: Column, window: int) -> Column:
    """Words covered by windows whose hash is found twice or more."""
    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twin = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
        return F.array_sort(F.filter(F.transform(s, lambda e, j: F.when(twin(e, j), e["i"])), lambda i: i.isNotNull()))

    # one-element arrays bind a value once, where a plain reference would be computed again for each element
    first = F.element_at(F.transform(F.array(ordered), starts), 1)
    nothing = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        first, nothing,
        lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )


def document_stats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed to `docs` (which has `text`)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    gone = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.withColumns({"_words": split_words(F.col("text"), SPACES), "_lines": lines})
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("_words", i, window)))
    step = step.withColumns({
        "n_words": n.cast("long"),
        "word_chars": gone(" \t\n\x0b\x0c\r").cast("long"),
        "n_symbols": (F.length(text) - gone(SYMBOLS)).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_hashes": F.when(n >= window, windows).otherwise(F.array().cast("array<bigint>")),
    }).drop("_words", "_lines")
    repeats = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    step = step.withColumn("n_repeat_words", F.when(repeats, _repeated(F.col("_hashes"), window)).otherwise(0).cast("long"))
    return step.drop("_hashes").withColumn("base_failed", F.expr(f"{RULES['short']} OR {RULES['repetitive']}"))


def host_counts(stats: DataFrame) -> DataFrame:
    """host, host_docs, host_failed (base rules) and failures of each rule, of `stats(host, ...)`; a row per host and task before the shuffle."""
    each = {rule: F.count_if(F.expr(test)) for rule, test in RULES.items()}
    return stats.filter("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("host_docs"), F.count_if("base_failed").alias("host_failed"),
        *[n.alias(f"failed_{rule}") for rule, n in each.items()],
    )


def host_verdicts(counts: DataFrame) -> DataFrame:
    """Add host_rejected to `counts(host, host_docs, failed_...)`: does the shrunk rate of any rule pass its limit?"""
    hosts = materialize(counts, "hosts")
    n = F.col("host_docs").cast("double")
    sums = [F.count(F.lit(1)).cast("double"), F.sum(n), F.sum(n * n)]
    for rule in RULES:
        f = F.col(f"failed_{rule}").cast("double")
        sums += [F.sum(f), F.sum(f * f / n)]
    # one row on the driver: sums over hosts
    k, total, squares, *found = (x or 0.0 for x in hosts.agg(*sums).first())
    passed = []
    for i, rule in enumerate(RULES):
        mean, strength, limit = prior(k, total, squares, *found[2 * i : 2 * i + 2])
        passed.append((F.col(f"failed_{rule}").cast("double") + strength * mean) / (n + strength) > limit)
    return hosts.withColumn("host_rejected", reduce(lambda a, b: a | b, passed))


def prior(hosts: float, total: float, squares: float, failed: float, spread: float) -> tuple[float, float, float]:
    """Mean and strength of the beta prior of a rule, and the rate from which a host is rejected.

    Sums over hosts: `total` documents, `squares` of documents, `failed` documents, `spread` of failed squared over documents. Were all
    hosts alike, their rates would still differ; what is over that, in units of the largest possible difference, is 1 / (strength + 1).
    """
    mean = failed / total if total else 0.0
    limit = min(max(FLOOR, RATIO * mean), (1 + mean) / 2)
    free = hosts - 1
    room = total - squares / total - free if total else 0.0
    if not 0 < mean < 1 or room <= 0:
        return mean, MAX_STRENGTH, limit
    beyond = ((spread - mean * mean * total) / (mean * (1 - mean)) - free) / room
    strength = MAX_STRENGTH if beyond <= 1 / (MAX_STRENGTH + 1) else max(1 / beyond - 1, 0.0)
    return mean, strength, limit


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: doc_id, host, the statistics, the verdict on its host, and `kept`."""
    view = docs.select("doc_id", "text", F.col(host).alias("host"))
    stats = materialize(document_stats(view).drop("text"), "quality")
    joined = stats.join(host_verdicts(host_counts(stats)), "host", "left")
    rejected = F.coalesce("host_rejected", F.lit(False))
    return joined.withColumns({"host_rejected": rejected, "kept": ~(F.col("base_failed") | rejected)})


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that pass, with their columns as they came."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    view = docs.select(row, F.col("text"), F.col(f"`{host}`").alias("host"))
    # written before the filter: the optimizer would copy the statistics into its condition, words split anew for each window;
    # and with the rows, since a join by a key would move every text once more
    judged = materialize(document_stats(view).drop("text"), "judged")
    rejected = host_verdicts(host_counts(judged)).filter("host_rejected").select("host")
    return restored(judged.filter("NOT base_failed").select("_row", "host").join(rejected, "host", "left_anti"), docs)


def by_length(docs: DataFrame) -> Column:
    """A finer host for `docs(source, n_chars)`: the source and how long the document is."""
    band = F.when(F.col("n_chars") < 100, "short").when(F.col("n_chars") < 1000, "medium").otherwise("long")
    return F.when(F.col("n_chars").isNotNull(), F.concat("source", F.lit("/"), band))
