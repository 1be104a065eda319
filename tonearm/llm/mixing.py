"""Documents of several sources combined to target shares of tokens.

Entropy balancing: each document gets a rate of use, as close as possible in
relative entropy to using every document once, such that each source
contributes its share of the mix in tokens and no document is used more than its source's limit. The
convex dual has one multiplier per source; rates are ``min(max_uses, exp(multiplier * tokens / mean))``. Newton steps on the
dual take its gradient and curvature from distributed sums over (source, tokens) counts; a bracket
keeps each step safe. Rates are rounded into copies by a hash of the document's id, so a
rate of 1.3 means one copy, and a second for 30 % of such documents.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.plans.staging import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# before a blank that follows no blank and precedes a letter a piece of the pattern ends, so cutting there changes no count
_CUT = re.compile(r"(?<=\S)(?= [^\W\d_])")


@functools.cache
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, which bound the cost of one call, cut only where the tokenizer cuts too."""
    start = 0
    while len(text) - start > size and (at := _CUT.search(text, start + size)):
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, tokens): whole texts counted by the tokenizer file, sources in lower case without outer blanks; a null text has 0 tokens."""
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.lower(F.trim(F.col(source))).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    with open(tokenizer, "rb") as f:  # read by the driver, sent to the executors, which may not have the file
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(sent.value)
        for b in batches:
            b["tokens"] = [sum(len(enc.encode_ordinary(p)) for p in pieces(t)) for t in b["text"]]
            yield b[["doc_id", "source", "tokens"]]

    return spread(rows).mapInPandas(count, "doc_id long, source string, tokens long")


def solve(counts: DataFrame, targets: list[tuple[str, float, int]], total: float, mean: float, steps: int = 60, close: float = 1e-9) -> dict[str, tuple[float, bool]]:
    """The multiplier of each source, and whether its target is reached, by safeguarded Newton steps.

    ``counts`` has (source, tokens, n). The dual is bounded: at the multiplier that puts even the shortest document at its limit it can grow no more. If its gradient
    is still positive there, the constraint is missed and the multiplier is ``inf`` (every document at its limit). Targets of 0 get ``-inf``.
    """
    spark = counts.sparkSession
    least = {r.source: r.least for r in counts.where("tokens > 0").groupBy("source").agg(F.min("tokens").alias("least")).collect()}
    out: dict[str, tuple[float, bool]] = {}
    open_: dict[str, list[float]] = {}
    for s, share, uses in targets:
        if share <= 0:
            out[s] = (-math.inf, True)
        elif s not in least or uses <= 0:
            out[s] = (math.inf, False)
        else:  # a multiplier giving less than asked, the bound, and where to begin: at the bound
            bound = max(0.0, math.log(uses)) * mean / least[s]
            open_[s] = [math.log(1e-12) * mean / least[s], bound, bound]
    limits = {s: (share * total, uses) for s, share, uses in targets}
    bounds = {s: x[1] for s, x in open_.items()}
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(s, float(x[2]), float(limits[s][1])) for s, x in open_.items()], "source string, m double, uses double")
        x = F.col("tokens") / F.lit(float(mean))
        rate = F.exp(F.least(F.col("m") * x, F.log("uses")))
        free = F.col("m") * x < F.log("uses")
        sums = counts.join(F.broadcast(now), "source").groupBy("source").agg(  # a row per source of the target table
            F.sum(F.col("n") * F.col("tokens") * rate).alias("got"), F.sum(F.when(free, F.col("n") * F.col("tokens") * x * rate).otherwise(0.0)).alias("slope")
        ).collect()
        for r in sums:
            low, high, m = open_[r.source]
            gap = r.got - limits[r.source][0]
            if abs(gap) <= close * total:
                out[r.source] = (m, True)
                del open_[r.source]
            elif m == bounds[r.source] and gap < 0:
                out[r.source] = (math.inf, False)
                del open_[r.source]
            elif m == bounds[r.source]:
                open_[r.source] = [low, high, min(0.0, (low + high) / 2) if high <= 0 else 0.0]
            else:
                low, high = (low, m) if gap > 0 else (m, high)
                step = m - gap / r.slope if r.slope > 0 else math.inf
                open_[r.source] = [low, high, step if low < step < high else (low + high) / 2]
    return out | {s: (x[2], True) for s, x in open_.items()}


def balance(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(mix, report). ``mix``: (doc_id, source, tokens, rate, copies); ``report``: a row per target source.

    ``targets`` has (source, target_share, max_uses), a short table of settings; of repeated sources the one first in order counts. Sources compare without case.
    ``total_tokens``: size of the mix, by default that of all documents. The report gives documents, tokens, capacity (tokens at ``max_uses``), target,
    whether the solved rates reach it, and the tokens of the rounded mix with two shares: ``share`` of the mix as it came out, which is smaller than wanted
    where a source falls short, and ``share_of_wanted``.

    Defined cases: a source that cannot reach its target uses each document ``max_uses`` times; documents of no target source, or without one, get
    no copies but count for the size of the mix; null texts have no tokens and get no copies; target sources without documents are reported with 0;
    no documents at all give a report of zeros.
    """
    spark = documents.sparkSession
    named: dict[str, tuple[str, float, int]] = {}
    for r in targets.select("source", "target_share", "max_uses").where("source is not null").distinct().orderBy("source").collect():
        named.setdefault(r.source.strip().lower(), (r.source, float(r.target_share or 0), int(r.max_uses or 0)))
    counted = stage(count_tokens(documents, tokenizer), "tokens")
    counts = stage(counted.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "token-counts")
    sizes = counts.agg(F.sum(F.col("n") * F.col("tokens")).alias("t"), F.sum("n").alias("n")).first()
    total = float(total_tokens if total_tokens is not None else sizes.t or 0)
    mean = max(1.0, (sizes.t or 0) / max(1, sizes.n or 0))
    found = solve(counts, [(s, share, uses) for s, (_, share, uses) in named.items()], total, mean)
    rows = [(s, name, share, uses, *found[s]) for s, (name, share, uses) in named.items()]
    limits = spark.createDataFrame(rows, "source string, name string, target_share double, max_uses int, multiplier double, reachable boolean")
    rate = F.when(F.col("tokens") <= 0, 0.0).when(F.col("multiplier") == float("inf"), F.col("max_uses").cast("double")).when(F.col("multiplier") == float("-inf"), 0.0).otherwise(
        F.exp(F.least(F.col("multiplier") * F.col("tokens") / F.lit(mean), F.log("max_uses")))
    )
    dice = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    mix = counted.join(F.broadcast(limits), "source").withColumn("rate", rate).withColumn("copies", F.least("max_uses", (F.floor("rate") + F.when(dice < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")))
    reached = mix.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    report = limits.join(reached, "source", "left").na.fill(0, ["documents", "tokens", "mixed_tokens"])
    all_mixed = reached.agg(F.coalesce(F.sum("mixed_tokens"), F.lit(0)).alias("all_mixed"))
    report = report.join(F.broadcast(all_mixed), how="cross").select(  # one row
        F.col("name").alias("source"), "target_share", "max_uses", "documents", "tokens",
        (F.col("tokens") * F.col("max_uses")).alias("capacity"),
        (F.col("target_share") * F.lit(total)).alias("target_tokens"),
        "reachable", "mixed_tokens",
        F.when(F.col("all_mixed") > 0, F.col("mixed_tokens") / F.col("all_mixed")).otherwise(0.0).alias("share"),
        F.when(F.lit(total) > 0, F.col("mixed_tokens") / F.lit(total)).otherwise(0.0).alias("share_of_wanted"),
    )
    return mix.select("doc_id", "source", "tokens", "rate", "copies"), report
