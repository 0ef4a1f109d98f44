"""Evaluation texts leaking into training text: q-gram filtering, banded alignment, exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.mail import chunks, parts, unquoted, words
from cellgrove.plans import cut, kept, ranked

RUN = 12
EDITS = 1
#: The filter of q-grams that is sent to every task has 2 to this power bits at most (32 MB). More q-grams of items only
#: let more positions through to the look-up, which decides.
MOST_BITS = 28
#: Characters of items whose inverted list is sent at once (about 16 bytes each); more items follow in further blocks,
#: which look at the same regions again, not at the mails.
BLOCK_CHARS = 4_000_000
#: Characters of a region; longer ones are cut with an overlap of the longest passage.
REGION = 2_000

_B = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q characters from each position on."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        h *= _B
        h += wide[j : j + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


#: Longer texts are searched in pieces that overlap by the longest passage, so that every passage lies whole in one.
PIECE = 1 << 21


def _pieces(text: str, overlap: int) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE + overlap:
        end = text.find(" ", at + PIECE + overlap, at + 2 * PIECE + overlap)
        yield text[at : end if end >= 0 else at + 2 * PIECE + overlap]
        at = max(text.rfind(" ", at + 1, at + PIECE) + 1, 0) or at + PIECE
    yield text[at:]


def _item_words(batches: Iterator[pd.DataFrame], run: int) -> Iterator[pd.DataFrame]:
    """item_id, item (its words with one blank between), least and most characters of its runs of `run` words."""
    for pdf in batches:
        out = []
        for i, t in zip(pdf["item_id"], pdf["text"], strict=True):
            w = words(t or "")
            if len(w) >= run:
                sizes = np.convolve([len(x) for x in w], np.ones(run, dtype=int), "valid") + run - 1
                out.append((i, " ".join(w), int(sizes.min()), int(sizes.max())))
        yield pd.DataFrame(out, columns=["item_id", "item", "least", "most"])


def _item_grams(batches: Iterator[pd.DataFrame], q: int) -> Iterator[pd.DataFrame]:
    """block, number, gram, at: the inverted list of the items' q-grams, an item named by its number in its block."""
    for pdf in batches:
        for block, number, t in zip(pdf["block"], pdf["number"], pdf["item"], strict=True):
            g = _qgrams(_codes(t), q).view(np.int64)
            yield pd.DataFrame({"block": block, "number": number, "gram": g, "at": np.arange(len(g), dtype=np.int32)})


@dataclass
class Block:
    """Some items and their inverted list, sorted by q-gram: item numbers and positions first[k] to first[k + 1] of keys[k]."""

    ids: list
    texts: list[str]
    needed: np.ndarray  # q-grams that the least demanding passage of each item shares with it
    keys: np.ndarray
    first: np.ndarray
    number: np.ndarray
    at: np.ndarray
    runs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def item_runs(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every run of words of every item the first character and the one behind the last, and where an item's begin."""
        if self.runs is None:
            ends = [np.r_[-1, np.flatnonzero(np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) == 32), len(t)] for t in self.texts]
            first, last = [e[:-run] + 1 for e in ends], [e[run:] for e in ends]
            self.runs = np.concatenate(first), np.concatenate(last), np.cumsum([0, *map(len, first)])
        return self.runs


@dataclass
class Search:
    """What a task needs to know of the items: their q-grams as a set of hashed bits, and the bounds of a passage."""

    q: int
    edits: int
    run: int
    bits: int
    filter: np.ndarray | None
    enough: int  # q-grams that the least demanding passage shares with its item
    most: int  # characters of the longest passage


def _regions(s: Search, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, str]]:
    """(text, start, positions, q-grams, region): the parts of texts where the items' q-grams lie close enough.

    A passage needs `enough` of them within its length, whichever item they are of. Positions and start are characters
    of the text; the region reaches a passage's length beyond the first and the last of its q-grams.
    """
    joined = _codes("\n".join(texts))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.cumsum(np.r_[0, lengths[:-1] + 1])
    h = _qgrams(joined, s.q)
    slot = (h >> np.uint64(64 - s.bits)).astype(np.int64)
    pos = np.flatnonzero(s.filter[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
    reach = s.most + s.edits
    near = np.searchsorted(pos, pos + reach, side="right") - np.searchsorted(pos, pos - reach, side="left")
    pos = pos[near >= s.enough]
    if not len(pos):
        return
    text = np.searchsorted(starts, pos, side="right") - 1
    cuts = np.flatnonzero((text[1:] != text[:-1]) | (np.diff(pos) > reach)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(pos)], strict=True):
        t, longest = int(text[a]), max(REGION, 4 * reach)
        while b - a >= s.enough:
            c = min(b, int(np.searchsorted(pos, pos[a] + longest)))
            p = pos[a:c] - starts[t]
            lo, hi = max(0, int(p[0]) - reach), int(p[-1]) + s.q + reach
            yield t, lo, p.astype(np.int32), h[pos[a:c]].view(np.int64), texts[t][lo:hi]
            if c == b:
                break
            a = int(np.searchsorted(pos, pos[c] - reach))


def _search(batches: Iterator[pd.DataFrame], s: Search) -> Iterator[pd.DataFrame]:
    """Every mail is decoded here, once: doc_id, start, region, positions and q-grams of its regions."""
    for pdf in chunks(batches):
        owner, texts = [], []
        for i, raw in zip(pdf["doc_id"], pdf["text"], strict=True):
            for p in parts(raw):
                w = words(unquoted(p.text))
                if len(w) >= s.run:
                    for piece in _pieces(" ".join(w), s.most + 2 * s.edits + 2):
                        owner.append(i)
                        texts.append(piece)
        if texts:
            rows = [(owner[t], lo, region, p, g) for t, lo, p, g, region in _regions(s, texts)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "region", "positions", "grams"])


#: Cells of the alignment's tables that a task holds at once.
CELLS = 4_000_000


def _fewest_edits(patterns: list[str], texts: list[str], edits: int) -> np.ndarray:
    """For each pattern the fewest edits (at most edits + 1 stands for more) with which it lies in its text.

    texts: what the pattern's band covers, starting edits + 1 characters before the pattern would on the first diagonal
    of the band, so that all ways of an occurrence lie within 4 (edits + 1) diagonals. Edit distance with free ends in the text, all pairs at once: one step per character of the pattern, one column per diagonal.
    """
    width = 4 * (edits + 1)
    n, m = len(patterns), max(map(len, patterns))
    a = np.zeros((n, m), dtype=np.uint32)
    b = np.ones((n, m + width), dtype=np.uint32)
    for r, (x, y) in enumerate(zip(patterns, texts, strict=True)):
        a[r, : len(x)] = _codes(x)
        y = y[: m + width]
        b[r, : len(y)] = _codes(y)
    size = np.array([len(x) for x in patterns])
    big = edits + 1
    d = np.zeros((n, width + 1), dtype=np.int16)  # the last column is the edge of the band
    d[:, -1] = big
    best = np.full(n, big, dtype=np.int16)
    for i in range(m):
        new = d[:, :-1] + (a[:, i : i + 1] != b[:, i : i + width])
        new = np.minimum(new, d[:, 1:] + 1)  # a character of the pattern is missing in the text
        for c in range(1, width):
            new[:, c] = np.minimum(new[:, c], new[:, c - 1] + 1)  # one too many there
        d[:, :-1] = np.minimum(new, big)
        ends = size == i + 1
        best[ends] = d[ends, :-1].min(axis=1)
    return best


def _able_runs(s: Search, block: Block, positions: np.ndarray, grams: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item number, first diagonal, firsts, lasts): the bands of diagonals that have enough q-grams in common with an
    item for a passage, with those runs of its words that have enough for themselves.

    Bands of twice the budget's diagonals overlap by half, so one of them holds all q-grams of a passage. firsts and
    lasts are the first character of each run and the one behind its last.
    """
    k = np.minimum(np.searchsorted(block.keys, grams), len(block.keys) - 1)
    true = block.keys[k] == grams
    pos, k = positions[true].astype(np.int64), k[true]
    if not len(k):
        return
    n = block.first[k + 1] - block.first[k]
    which = np.repeat(np.arange(len(pos)), n)
    entry = np.repeat(block.first[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    number, at = block.number[entry].astype(np.int64), block.at[entry].astype(np.int64)
    width, lift = 2 * (s.edits + 1), 1 << 31
    run_first, run_last, offset = block.item_runs(s.run)
    for half in (0, s.edits + 1):
        band = (pos[which] - at + half + lift) // width
        order = np.argsort((number << 32) | band, kind="stable")
        a, b = number[order], band[order]
        cuts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[cuts, len(a)])
        full = size >= block.needed[a[cuts]]
        item, size_of = a[cuts][full], size[full]
        place = np.arange(len(item)) << 32
        held = np.sort(np.repeat(place, size_of) | at[order[np.repeat(full, size)]])
        runs = offset[item + 1] - offset[item]
        of = np.repeat(np.arange(len(item)), runs)
        r = np.repeat(offset[item] - np.r_[0, np.cumsum(runs)[:-1]][: len(item)], runs) + np.arange(runs.sum())
        first, last = run_first[r], run_last[r]
        common = np.searchsorted(held, place[of] + np.maximum(last - s.q, -1), side="right") - np.searchsorted(held, place[of] + first, side="left")
        able = common >= np.maximum(1, last - first + 1 - s.q * (s.edits + 1))
        of, first, last = of[able], first[able], last[able]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, dtype=np.int64)
        for x, y in zip(starts, np.r_[starts[1:], len(of)], strict=True) if len(of) else ():
            yield int(item[of[x]]), int(b[cuts][full][of[x]]) * width - half - lift, first[x:y], last[x:y]


def _leaks(batches: Iterator[pd.DataFrame], s: Search, block: Block) -> Iterator[pd.DataFrame]:
    """doc_id, item_id, edits of the passages of a block's items in the regions.

    Of each band with enough common q-grams, the runs of the item's words that have enough of their own are looked for
    in the region, on the diagonals of the band, by alignment; runs that stand there letter for letter need none.
    """
    for pdf in batches:
        out, waiting, cells = [], [], 0

        def align(out=out):
            fewest = _fewest_edits([w[1] for w in waiting], [w[2] for w in waiting], s.edits)
            out += [(*w[0], int(e)) for w, e in zip(waiting, fewest, strict=True) if e <= s.edits]

        slack = s.edits + 1
        for doc, start, region, positions, grams in pdf[["doc_id", "start", "region", "positions", "grams"]].itertuples(index=False):
            text = f" {region} "
            for number, diagonal, firsts, lasts in _able_runs(s, block, positions, grams):
                own, item_id = f" {block.texts[number]} ", block.ids[number]
                shift = diagonal - start + 1  # of a character of the item in the padded region
                runs = [(a - 1 + shift - slack, own[a : b + 2]) for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True)]
                around = [text[max(0, at) : at + len(r) + 4 * slack] for at, r in runs]
                if any(r in t for (_, r), t in zip(runs, around, strict=True)):
                    out.append((doc, item_id, 0))
                    continue
                for (at, r), t in zip(runs, around, strict=True) if s.edits else ():
                    waiting.append(((doc, item_id), r, "\1" * max(0, -at) + t))
                    cells += len(r) + 4 * slack
                if cells > CELLS:
                    align()
                    waiting, cells = [], 0
        if waiting:
            align()
        yield pd.DataFrame(out, columns=["doc_id", "item_id", "edits"])


def leaked_items(docs: DataFrame, items: DataFrame, run: int = RUN, edits: int = EDITS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits: mails with a text part that holds at least run consecutive words of an item, with the
    fewest changed, missing or additional characters (0 to the parameter edits) of such a passage.

    docs: doc_id, text (raw mails, read whole). items: item_id, text. Words are runs of letters and digits, case
    ignored; parts are compared as their words with one blank between. The q-grams of all items are an inverted list
    that Spark builds and sorts. Every mail is decoded once, in the pass that keeps the regions dense in q-grams of any
    item (known by a bit set). The regions are then looked up in the list, sent block by block: bands of diagonals with
    as many common q-grams as a passage within the edit budget shares are aligned. Null or empty texts hold nothing,
    items of fewer than run words cannot leak; repeated mails and repeated items count once per id; those without an id
    are left out.
    """
    spark = docs.sparkSession
    own = items.where("item_id is not null and text is not null").select("item_id", "text")
    own = cut(own.mapInPandas(lambda b: _item_words(b, run), "item_id bigint, item string, least int, most int"))
    bound = own.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum(F.length("item")).alias("chars")).first()
    if bound.least is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint, edits int")
    q = int(max(3, min(16, bound.least // (edits + 2))))
    # a passage of `least` characters with so many edits shares least + 1 - q * (edits + 1) q-grams with its item
    share = lambda least: F.greatest(F.lit(1), least + 1 - q * (edits + 1))
    blocks = -(-bound.chars // block_chars)
    numbered = ranked(own.withColumn("block", F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)).cast("int")), ["block"], ["item_id", "item"], "number")
    numbered = cut(numbered.select("block", (F.col("number") - 1).cast("int").alias("number"), "item_id", "item", share(F.col("least")).cast("int").alias("needed")))
    grams = kept(numbered.select("block", "number", "item").mapInPandas(lambda b: _item_grams(b, q), "block int, number int, gram bigint, at int"))
    bits = min(MOST_BITS, max(16, int(bound.chars).bit_length() + 4))
    octets = grams.select(F.shiftrightunsigned("gram", 64 - bits).alias("s")).groupBy(F.floor(F.col("s") / 8).cast("int").alias("octet")).agg(F.expr("bit_or(shiftleft(1, cast(s % 8 as int)))").alias("v")).toPandas()  # at most 2^bits / 8 rows
    known = np.zeros(1 << (bits - 3), dtype=np.uint8)
    known[octets["octet"].to_numpy()] = octets["v"].to_numpy()
    search = Search(q, edits, run, bits, known, max(1, int(bound.least) + 1 - q * (edits + 1)), int(bound.most))
    filtering = spark.sparkContext.broadcast(search)
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    regions = cut(texts.mapInPandas(lambda b: _search(b, filtering.value), "doc_id bigint, start int, region string, positions array<int>, grams array<bigint>"))

    bounds, out = replace(search, filter=None), []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).orderBy("number").toPandas()  # of a block: bounded by block_chars
        if not len(rows):
            continue
        listed = grams.where(F.col("block") == b).select("gram", "number", "at").orderBy("gram").toPandas()
        keys, first = np.unique(listed["gram"].to_numpy(), return_index=True)
        block = Block(rows["item_id"].tolist(), rows["item"].tolist(), rows["needed"].to_numpy(), keys, np.r_[first, len(listed)], listed["number"].to_numpy(), listed["at"].to_numpy())
        shipped = spark.sparkContext.broadcast(block)
        out.append(regions.mapInPandas(lambda batches, shipped=shipped: _leaks(batches, bounds, shipped.value), "doc_id bigint, item_id bigint, edits int"))
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, suite, n_docs: in how many mails each test item leaked, 0 for the clean ones."""
    n = found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    return items.select("item_id", "suite").join(n, "item_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
