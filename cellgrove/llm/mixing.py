"""Mixing sources to target weights in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.functions import fold, uniform
from cellgrove.plans import cut, few, kept, running_total

#: A rank file of a public tokenizer, present on every executor, and the pattern that goes with it.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Very long texts are counted in pieces of at least this many characters, so that memory stays bounded. A piece ends
#: where a run of letters or of digits ends: the pattern above begins a token there in the whole text as well (what
#: stands before has no part in it), so the tokens are those of the whole text. A run without an end is not cut.
PIECE = 1 << 20
_END = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE and (end := _END.search(text, at + PIECE)) and end.start() < len(text):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def with_tokens(df: DataFrame, text: str = "text", into: str = "n_tokens", ranks: str = RANKS) -> DataFrame:
    """Adds the number of tokens of the whole text; 0 for an empty or null one."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(ranks).encode_ordinary
        return texts.map(lambda t: sum(len(encode(p)) for p in _pieces(t)) if t else 0).astype("int64")

    return df.withColumn(into, count(F.col(text)))


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(selection, report) of every mix.

    docs: doc_id, source, n_tokens, quality (weight above 0; null or not above 0 counts as least). targets: mix_id,
    source, weight, max_repeats, total_tokens. Sources are folded on both sides; repeated documents are documents;
    documents without source or id and lines without mix or source are left out. A source needs weight *
    total_tokens; it gives as many complete epochs as fit into the need, at most max_repeats, and while repeats are
    left, a fraction of one more: documents in the order of exponential keys -ln(u) / quality (Efraimidis-Spirakis
    sampling; doc_id decides ties), as long as their running total stays within the rest. Empty documents cost
    nothing. selection: mix_id, source, doc_id, copies. report: mix_id, source, weight, need_tokens, supply_tokens,
    max_repeats, epochs, given_tokens, capped (every document with tokens was drawn max_repeats times and the need is still not
    met), share (of the tokens that the mix really gets, null if it gets none). Both come from the drawn documents. Equal
    lines count once; different ones of a mix and source add up their weights, under the largest of the other values.
    """
    docs = docs.select("doc_id", fold("source").alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.greatest(F.coalesce("quality", F.lit(0.0)), F.lit(1e-6)).alias("quality")).where("doc_id is not null and source is not null")
    lines = targets.select("mix_id", fold("source").alias("source"), "weight", "max_repeats", "total_tokens").where("mix_id is not null and source is not null").distinct()
    lines = lines.groupBy("mix_id", "source").agg(F.sum("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"), F.max("total_tokens").alias("total_tokens"))
    supply = docs.groupBy("source").agg(F.sum("n_tokens").alias("supply_tokens"), F.sum((F.col("n_tokens") > 0).cast("bigint")).alias("n_docs"))
    lines = lines.join(supply, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("supply_tokens", "n_docs")})
    lines = lines.withColumn("need_tokens", F.coalesce(F.col("weight") * F.col("total_tokens"), F.lit(0.0))).withColumn("max_repeats", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))
    fit = F.when(F.col("supply_tokens") > 0, F.floor(F.col("need_tokens") / F.col("supply_tokens"))).otherwise(F.lit(0))
    lines = lines.withColumn("epochs", F.least(fit, F.col("max_repeats").cast("bigint")))
    rest = F.when(F.col("epochs") < F.col("max_repeats"), F.col("need_tokens") - F.col("epochs") * F.col("supply_tokens")).otherwise(F.lit(0.0))
    lines = cut(lines.withColumn("rest", rest))

    short = few(lines.where("rest > 0 and supply_tokens > 0").select("mix_id", "source", "rest"))
    keyed = docs.join(short, "source").withColumn("key", -F.log(uniform(F.lit(seed), "mix_id", "doc_id")) / F.col("quality"))
    run = running_total(keyed.select("mix_id", "source", "doc_id", "n_tokens", "rest", "key"), ["mix_id", "source"], ["key", "doc_id"], "n_tokens", "upto")
    part = run.where(F.col("upto") <= F.col("rest")).select("mix_id", "source", "doc_id", "n_tokens", F.lit(1).cast("bigint").alias("copies"))
    whole = docs.join(few(lines.where("epochs > 0").select("mix_id", "source", "epochs")), "source").select("mix_id", "source", "doc_id", "n_tokens", F.col("epochs").alias("copies"))
    both = whole.unionByName(part).groupBy("mix_id", "source", "doc_id").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    selection = kept(both)

    given = selection.groupBy("mix_id", "source").agg(F.sum("tokens").alias("given_tokens"), F.sum(F.when(F.col("tokens") > 0, F.col("copies")).otherwise(0)).alias("given_copies"))
    report = lines.join(given, ["mix_id", "source"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("given_tokens", "given_copies")})
    total = report.groupBy("mix_id").agg(F.sum("given_tokens").alias("mix_tokens"))
    report = report.join(total, "mix_id").withColumn("share", F.when(F.col("mix_tokens") > 0, F.col("given_tokens") / F.col("mix_tokens")))
    capped = (F.col("given_tokens") < F.col("need_tokens")) & (F.col("given_copies") >= F.col("max_repeats") * F.col("n_docs"))
    return selection.drop("tokens"), report.select("mix_id", "source", "weight", "need_tokens", "supply_tokens", "max_repeats", "epochs", "given_tokens", capped.alias("capped"), "share")
