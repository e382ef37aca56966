"""Main text of web pages: markup tells furniture, and a suffix array of each host tells what its pages repeat.

The words of a host's pages are put behind one another, a mark after each block, and suffixes are sorted by doubling up to RUN
tokens; a prefix on too few distinct pages is not extended. Text repeated on two or more pages outside of articles is boilerplate;
so is text of the article itself that nearly all pages of a host share, as long as it is not most of the article. What is
left are the page's own runs. A host too large for one task is cut into parts by a hash of its pages; the parts' distinct runs outside of
articles meet in a shuffle, and runs of articles that half of the pages of most parts have are counted in all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, held, reuse_freed_memory
from .html_text import CHROME, OPEN, Block, article_part, blocks

#: Tokens of the shortest repeated run; marks of block ends count.
RUN = 8
#: Bytes of html of one part of a host.
PART_BYTES = 8 << 20
#: Distinct pages that repeat a run outside of articles, and share and least number of a host's distinct pages that repeat one in articles.
REPEATED, SHARED, LEAST_PAGES = 2, 0.9, 10
#: Share of a block, and of an article, that must be repeated to go, and words from which a block is a paragraph.
COVERED, MOST, PARAGRAPH = 0.5, 0.5, 20
#: Share of a part's distinct pages from which it names a run of articles, and the least share of the host's pages that must be in parts that
#: name a run on SHARED of them: parts that do not name it lack it on more than 1 - LISTED of their pages.
LISTED = 0.5
NAMED = 1 - (1 - SHARED) / (1 - LISTED)
#: A token is 24 bits of its word's hash; 0 is the mark of a block's end.
BITS, MARK = 24, 0
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
KEPT_WORDS = 500_000
STREAMS = "host string, part int, parts int, page long, named boolean, outer binary, inner binary"
RUNS = "host string, part int, parts int, inner boolean, run long, first long, last long, wanted boolean"
TEXTS = "page_id long, url string, text string, n_chars long"


class _Tokens(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        h = self[word] = 1 + xxhash.xxh32_intdigest(word) % ((1 << BITS) - 1)
        return h


def tokens(found: list[Block]) -> np.ndarray:
    """Numbers of the words of blocks, a mark after each block."""
    numbers = held("boilerplate", _Tokens)
    out: list[int] = []
    for b in found:
        out += map(numbers.__getitem__, b.text.split())
        out.append(MARK)
    return np.array(out, np.uint32)


def _packed(stream: np.ndarray) -> bytes:
    return stream.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
    return b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16


def split(found: list[Block]) -> tuple[list[Block], list[Block], bool]:
    """Blocks outside of the article, blocks of the article, and whether the markup names one."""
    part = article_part(found)
    if part <= OPEN:
        return found, [], False
    return [b for b in found if b.part != part], [b for b in found if b.part == part], True


def host_of(url: str | Column) -> Column:
    """Host name of a url in lower case; '' where it has none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def runs_of(stream: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit numbers of the RUN tokens from each place on."""
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(RUN):
            h = (h ^ stream[at + k].astype(np.uint64)) * MULTIPLY
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def suffixes(stream: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, starts, pages): places in the stream sorted by the RUN tokens from there on, where each distinct run's places
    start, and on how many pages it stands; of runs on at least so many pages. page: which page a token is of, ascending, -1 between pages."""
    many = int(page.max(initial=0)) + 1
    at, length = np.flatnonzero(page >= 0), 1
    rank = np.where(page >= 0, stream, -1).astype(np.int64)
    while True:
        # Prefixes of this length on too few pages go; each extension of one is on no more.
        if least > 1:
            both = np.sort(rank[at] * many + page[at])
            distinct, pages = np.unique(both[np.concatenate(([True], both[1:] != both[:-1]))] // many if len(both) else both, return_counts=True)
            keep = (pages >= least)[np.searchsorted(distinct, rank[at])] if len(at) else np.zeros(0, bool)
            gone = at[~keep]
            rank[gone] = -1
            at = at[keep]
        if length >= RUN or not len(at):
            break
        at = at[at + length < len(stream)]
        at = at[(rank[at + length] >= 0) & (page[at + length] == page[at])]
        key = rank[at] * (int(rank.max()) + 1) + rank[at + length]
        rank[:] = -1
        rank[at] = np.unique(key, return_inverse=True)[1]
        length *= 2
    order = np.argsort(rank[at], kind="stable")
    at, ranks = at[order], rank[at][order]
    starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(at) else np.zeros(0, np.int64)
    new_page = np.concatenate(([True], (ranks[1:] != ranks[:-1]) | (page[at][1:] != page[at][:-1]))) if len(at) else np.zeros(0, bool)
    return at, starts, np.add.reduceat(new_page.astype(np.int64), starts) if len(starts) else starts


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pages' tokens with a gap between pages, and which page each is of."""
    parts = [_unpacked(r) for r in raw]
    gap = np.full(1, -1, np.int64)
    stream = np.concatenate([x for p in parts for x in (p, gap)] or [gap])
    page = np.concatenate([x for k, p in enumerate(parts) for x in (np.full(len(p), k), gap)] or [gap])
    return stream, page


def _streams(pages: DataFrame) -> DataFrame:
    """STREAMS: tokens of each page outside and inside of its article; each task gives a host's equal pages once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        seen = set()
        for batch in batches:
            rows = []
            for host, part, parts, page in zip(*(batch[c].to_pylist() for c in ("host", "part", "parts", "html")), strict=True):
                outer, inner, named = split(blocks(page))
                outer, inner = _packed(tokens(outer)), _packed(tokens(inner))
                key = xxhash.xxh64_intdigest(outer + b"|" + inner) - (1 << 63)
                if (host, key) not in seen:
                    seen.add((host, key))
                    rows.append((host, part, parts, key, named, outer, inner))
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["host", "part", "parts", "page", "named", "outer", "inner"]).astype({"part": "int32", "parts": "int32", "page": "int64", "named": bool}), preserve_index=False) if rows else pa.RecordBatch.from_pylist([], schema=_SCHEMA)

    return pages.select("host", "part", "parts", "html").mapInArrow(read, STREAMS)


_SCHEMA = pa.schema([("host", pa.string()), ("part", pa.int32()), ("parts", pa.int32()), ("page", pa.int64()), ("named", pa.bool_()), ("outer", pa.binary()), ("inner", pa.binary())])


def _runs(group: pd.DataFrame) -> pd.DataFrame:
    """RUNS that a host of one part repeats; of one part of several, all that it has outside of articles."""
    group = group.drop_duplicates("page").sort_values("page")
    host, part, parts = group["host"].iloc[0], int(group["part"].iloc[0]), int(group["parts"].iloc[0])
    keys, named, out = group["page"].to_numpy(), group["named"].to_numpy(), []
    least = max(LEAST_PAGES, int(np.ceil(SHARED * len(group))))
    for inner, need in ((False, REPEATED if parts == 1 else 1), (True, least)):
        if need > len(group) or (inner and parts > 1):
            continue
        stream, page = _joined(group["inner" if inner else "outer"].tolist())
        at, starts, _ = suffixes(stream, page, need)
        ends = np.append(starts[1:], len(at))[: len(starts)] - 1
        wanted = np.logical_or.reduceat(~named[page[at]], starts) if len(starts) else np.zeros(0, bool)
        if inner:
            wanted[:] = True
        elif parts == 1:
            starts, ends, wanted = starts[wanted], ends[wanted], wanted[wanted]
        out.append(pd.DataFrame({"run": runs_of(stream, at[starts]), "first": keys[page[at[starts]]], "last": keys[page[at[ends]]], "wanted": wanted}).assign(inner=inner))
    names = ["host", "part", "parts", "inner", "run", "first", "last", "wanted"]
    return pd.concat(out).assign(host=host, part=part, parts=parts)[names] if out else pd.DataFrame(columns=names)


def _listed(group: pd.DataFrame) -> pd.DataFrame:
    """(host, parts, run, pages): runs of articles on a good share of the distinct pages of one part of a host, and the number of its pages."""
    group = group.drop_duplicates("page").sort_values("page")
    stream, page = _joined(group["inner"].tolist())
    at, starts, _ = suffixes(stream, page, int(np.ceil(LISTED * len(group))))
    return pd.DataFrame({"run": runs_of(stream, at[starts])}).assign(host=group["host"].iloc[0], parts=group["parts"].iloc[0], pages=len(group))[["host", "parts", "run", "pages"]]


def _counted(group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """(host, run, n): on how many distinct pages of one part each wanted run stands in the article."""
    if not len(group) or not len(wanted):
        return pd.DataFrame(columns=["host", "run", "n"])
    group = group.drop_duplicates("page")
    stream, page = _joined(group["inner"].tolist())
    at = np.flatnonzero(page[: len(page) - RUN + 1] >= 0)
    at = at[page[at + RUN - 1] == page[at]]
    runs, known = runs_of(stream, at), np.unique(wanted["run"].to_numpy())
    hit = np.isin(runs, known)
    on = np.unique(np.searchsorted(known, runs[hit]) * len(group) + page[at[hit]])
    which, n = np.unique(on // len(group), return_counts=True)
    return pd.DataFrame({"run": known[which], "n": n}).assign(host=group["host"].iloc[0])[["host", "run", "n"]]


def shared_in_articles(streams: DataFrame) -> DataFrame:
    """(host, parts, run): runs in the articles of nearly all distinct pages of hosts of several parts, counted exactly over all parts.

    Equal pages meet in one part here. A part names the runs on half of its pages; a run on SHARED of a host's pages is named by parts that
    hold at least NAMED of them, so few are left to be counted everywhere, whatever the number of parts.
    """
    own = streams.select("host", "parts", "page", "inner").withColumn("part", F.pmod("page", F.col("parts").cast("long")).cast("int"))
    sizes = checkpointed(own.groupBy("host").agg(F.countDistinct("page").alias("of")))
    listed = own.groupBy("host", "part").applyInPandas(_listed, "host string, parts int, run long, pages long").groupBy("host", "parts", "run").agg(F.sum("pages").alias("pages"))
    wanted = checkpointed(listed.join(sizes, "host").where(F.col("pages") >= F.floor(NAMED * F.col("of"))).select("host", "parts", "run"))
    everywhere = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    counts = own.groupBy("host", "part").cogroup(everywhere.groupBy("host", "part")).applyInPandas(_counted, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("n"))
    found = counts.join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.ceil(F.lit(SHARED) * F.col("of"))))
    return found.select("host", "run").join(wanted, ["host", "run"]).select("host", "parts", "run")


def repeated_runs(pages: DataFrame, cut_hosts: bool) -> DataFrame:
    """(host, part, outer, inner): the runs that are boilerplate in each part of a host, outside and inside of articles."""
    columns = ["host", "part", "inner", "run"]
    runs = checkpointed(_streams(pages.where("parts = 1")).groupBy("host", "part").applyInPandas(_runs, RUNS).select(*columns))
    if cut_hosts:
        streams = checkpointed(_streams(pages.where("parts > 1")))
        cut = streams.groupBy("host", "part").applyInPandas(_runs, RUNS)
        over = Window.partitionBy("host", "run")  # at most one row a part
        cut = cut.withColumns({"least": F.min("first").over(over), "most": F.max("last").over(over), "any": F.max("wanted").over(over)}).where((F.col("least") < F.col("most")) & F.col("any"))
        shared = shared_in_articles(streams).select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("inner"), "run")
        runs = runs.unionByName(checkpointed(cut.select(*columns))).unionByName(checkpointed(shared))
    runs = runs.groupBy("host", "part")
    return runs.agg(F.collect_list(F.when(~F.col("inner"), F.col("run"))).alias("outer"), F.collect_list(F.when(F.col("inner"), F.col("run"))).alias("inner"))


def _covered(found: list[Block], runs: np.ndarray) -> list[float]:
    """The share of each block's words that lie in one of the runs (sorted)."""
    if not len(runs) or len(stream := tokens(found)) < RUN:
        return [0.0] * len(found)
    h = runs_of(stream, np.arange(len(stream) - RUN + 1))
    hit = runs[np.minimum(np.searchsorted(runs, h), len(runs) - 1)] == h
    depth = np.zeros(len(stream) + 1, np.int64)
    depth[: len(hit)] += hit
    depth[RUN : RUN + len(hit)] -= hit
    inside, out, at = np.cumsum(depth)[:-1] > 0, [], 0
    for b in found:
        n = len(b.text.split())
        out.append(float(inside[at : at + n].mean()))
        at += n + 1
    return out


def main_text(page: str | None, outer: np.ndarray, inner: np.ndarray) -> str:
    """The article's blocks of a page, parted by empty lines, given the host's repeated runs (sorted)."""
    around, article, named = split(blocks(page))
    if named:
        share = _covered(article, inner)
        words = [len(b.text.split()) for b in article]
        gone = [s > COVERED for s in share]
        if sum(w for w, g in zip(words, gone, strict=True) if g) > MOST * sum(words):
            gone = [False] * len(article)  # copies of an article are no boilerplate
        return "\n\n".join(b.text for b, g in zip(article, gone, strict=True) if not g)
    share = _covered(around, outer)
    free = [(b, s) for b, s in zip(around, share, strict=True) if b.part != CHROME]
    kept = [b for b, s in free if s <= COVERED]
    if not any(len(b.text.split()) >= PARAGRAPH for b in kept):
        kept = [b for b, s in free if s <= COVERED or len(b.text.split()) >= PARAGRAPH]
    return "\n\n".join(b.text for b in kept)


def extract(pages: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per page its id, url, main text and the text's code points.

    Where the markup names an article, its blocks are the text, but for furniture within and for runs that nearly all pages of the host
    have there. Elsewhere blocks that are neither furniture nor mostly repeated on another page of the host are; a page whose
    paragraphs are all repeated, as copies are, keeps them. Equal pages of a host count as one. Null and empty html gives an empty text,
    pages without a host are taken as of one host, repeated rows give repeated rows, null ids and urls stay; html of any length is read
    whole; extra columns are ignored; an empty table gives no rows.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of("url"))
    sizes = pages.groupBy("host").agg(F.sum(F.octet_length("html")).alias("bytes"))
    # Written, so that its size is known: Spark joins it by broadcast only below the session's bound.
    large = checkpointed(sizes.where(F.col("bytes") > part_bytes).select("host", F.ceil(F.col("bytes") / part_bytes).cast("int").alias("parts")))
    pages = pages.join(large, "host", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    pages = pages.withColumn("part", F.pmod(F.xxhash64("html"), F.col("parts").cast("long")).cast("int"))
    found = pages.join(checkpointed(repeated_runs(pages, not large.isEmpty())), ["host", "part"], "left").select("page_id", "url", "html", "outer", "inner")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_freed_memory()
        none = np.zeros(0, np.int64)
        for batch in batches:
            out = []
            for page, outer, inner in zip(batch["html"], batch["outer"], batch["inner"], strict=True):
                outer, inner = (np.sort(x.values.to_numpy()) if x.is_valid else none for x in (outer, inner))
                out.append(main_text(page.as_py(), outer, inner))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return found.mapInArrow(texts, TEXTS)
