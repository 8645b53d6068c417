"""Hierarchical chunking: header sections, parents, children.

The folds over one document's chunks depend on their order, so they run row by
row inside ``mapInArrow``: a document never leaves its row, and nothing is
shuffled. Lengths are code points.

Our specification where libraries differ. Sections: lines are stripped of
white space and of characters that can't be printed; a header is a marker of
one to three ``#`` alone or before a space; fences (three backticks or tildes)
suspend headers; a new header drops deeper and equal levels; a blank line ends a
paragraph; neighbouring paragraphs with equal headers are joined by two spaces
and a line end, and so is a paragraph that is only a header with its deeper
successor. Recursive splitting: at the first of the separators blank line,
line end, space, nothing that occurs; a separator stays with what follows it;
pieces are merged up to the size, and the next chunk starts with as many of the
last pieces as the overlap allows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import config
from corvane.functions.text import valid_utf8
from corvane.storage import bound_batches

Chunk = tuple[str, dict[str, str]]
SEPARATORS = ("\n\n", "\n", " ", "")


def split_headers(text: str | None) -> list[Chunk]:
    """Sections of a markdown text with their header path."""
    paragraphs: list[tuple[list[str], dict[str, str]]] = []
    lines: list[str] = []
    path: list[tuple[int, str]] = []
    fence = ""

    def end() -> None:
        nonlocal lines
        if lines:
            paragraphs.append((lines, {f"H{level}": title for level, title in path}))
            lines = []

    for raw in (text or "").split("\n"):
        line = "".join(c for c in raw.strip() if c.isprintable())
        if fence:
            lines.append(line)
            if line.startswith(fence):
                fence = ""
            continue
        if line.startswith(("```", "~~~")) and line.count(line[:3]) == 1:
            fence = line[:3]
            lines.append(line)
            continue
        level = next((n for n in (3, 2, 1) if line.startswith("#" * n) and (len(line) == n or line[n] == " ")), 0)
        if level:
            end()
            path = [p for p in path if p[0] < level] + [(level, line[level:].strip())]
            lines.append(line)
        elif line:
            lines.append(line)
        else:
            end()
    end()
    out: list[Chunk] = []
    for own, meta in paragraphs:
        content = "\n".join(own)
        if out and out[-1][1] == meta:
            out[-1] = (f"{out[-1][0]}  \n{content}", meta)
        elif out and len(out[-1][1]) < len(meta) and out[-1][0].split("\n")[-1].startswith("#"):
            out[-1] = (f"{out[-1][0]}  \n{content}", meta)
        else:
            out.append((content, meta))
    return out


def join_meta(old: dict[str, str], new: dict[str, str]) -> dict[str, str]:
    """Values of a shared key become ``old -> new``."""
    return old | {k: f"{old[k]} -> {v}" if k in old else v for k, v in new.items()}


def _joined(a: Chunk, b: Chunk) -> Chunk:
    return f"{a[0]}\n\n{b[0]}", join_meta(a[1], b[1])


def merge_small(chunks: list[Chunk], least: int = config.MIN_PARENT) -> list[Chunk]:
    """Neighbours are joined until they reach ``least``; what is left at the end goes to the last one."""
    out: list[Chunk] = []
    open_: Chunk | None = None
    for c in chunks:
        open_ = c if open_ is None else _joined(open_, c)
        if len(open_[0]) >= least:
            out.append(open_)
            open_ = None
    if open_ is not None:
        if out:
            out[-1] = _joined(out[-1], open_)
        else:
            out.append(open_)
    return out


def clean_small(chunks: list[Chunk], least: int = config.MIN_PARENT) -> list[Chunk]:
    """A chunk below ``least`` goes to the one before, the first one to the one after."""
    out: list[Chunk] = []
    carried: Chunk | None = None
    for i, c in enumerate(chunks):
        if carried is not None:
            c, carried = _joined(carried, c), None
        if len(c[0]) >= least:
            out.append(c)
        elif out:
            out[-1] = _joined(out[-1], c)
        elif i + 1 < len(chunks):
            carried = c
        else:
            out.append(c)
    return out


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, stripped, none empty."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    separator, rest = separators[at], separators[at + 1 :]
    if separator:
        pieces = text.split(separator)
        pieces = [p for p in (pieces[0], *(separator + p for p in pieces[1:])) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in pieces:
        if len(p) < size or not rest:
            short.append(p)
            continue
        out += _merged(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, rest)
    return out + _merged(short, size, overlap)


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    begin = total = 0
    for i, p in enumerate(pieces):
        if total + len(p) > size and i > begin:
            out.append("".join(pieces[begin:i]).strip())
            while total > overlap or (total + len(p) > size and total > 0):
                total -= len(pieces[begin])
                begin += 1
        total += len(p)
    if begin < len(pieces):
        out.append("".join(pieces[begin:]).strip())
    return [c for c in out if c]


def split_large(chunks: list[Chunk], most: int = config.MAX_PARENT, overlap: int = config.CHILD_OVERLAP) -> list[Chunk]:
    """Chunks over ``most`` characters are split, each part with the same headers."""
    return [(part, c[1]) for c in chunks for part in ([c[0]] if len(c[0]) <= most else split_text(c[0], most, overlap))]


def parents(text: str | None) -> list[Chunk]:
    """All steps from a markdown text to its parent chunks."""
    return clean_small(split_large(merge_small(split_headers(text))))


_META = pa.map_(pa.string(), pa.string())


def _per_document(docs: DataFrame, key: str, text: str, make: Callable[[str | None], list[Chunk]], stem: Column | None = None) -> DataFrame:
    """One row for each chunk that ``make`` finds in a text: key, place, content, metadata; ``stem`` is carried along."""
    bound_batches(docs.sparkSession)
    names = ["key", "idx", "content", "metadata"] + ["stem"] * (stem is not None)
    types = [pa.int64(), pa.int32(), pa.string(), _META, pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [(k, i, c, list(m.items()), *more) for k, t, *more in zip(*(c.to_pylist() for c in part.columns), strict=True) for i, (c, m) in enumerate(make(t))]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types[: len(names)], strict=True)], names)

    own = [F.col(key).cast("long").alias("key"), valid_utf8(F.col(text).cast("string")).alias("text")]
    rows = docs.select(*own, *([] if stem is None else [stem.alias("stem")]))
    schema = "key long, idx int, content string, metadata map<string,string>" + (", stem string" if stem is not None else "")
    return rows.mapInArrow(each, schema).withColumnRenamed("key", key)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _per_document(docs, key, text, split_headers)


def merged_sections(docs: DataFrame, key: str, text: str, least: int = config.MIN_PARENT) -> DataFrame:
    return _per_document(docs, key, text, lambda t: merge_small(split_headers(t), least))


def cleaned_sections(docs: DataFrame, key: str, text: str, least: int = config.MIN_PARENT) -> DataFrame:
    return _per_document(docs, key, text, lambda t: clean_small(split_headers(t), least))


def split_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _per_document(docs, key, text, lambda t: split_large(split_headers(t)))


def parent_id(stem: Column, index: Column) -> Column:
    return F.concat(stem, F.lit("_parent_"), index.cast("string"))


def parent_chunks(docs: DataFrame, key: str, text: str, stem: Column) -> DataFrame:
    """``key, parent_id, idx, content, metadata``; the metadata also name the source and the parent."""
    rows = _per_document(docs, key, text, parents, stem)
    own_id = parent_id(F.col("stem"), F.col("idx"))
    own = F.create_map(F.lit("source"), F.concat("stem", F.lit(".pdf")), F.lit("parent_id"), own_id)
    return rows.select(key, own_id.alias("parent_id"), "idx", "content", F.map_concat("metadata", own).alias("metadata"))


def child_chunks(parent_rows: DataFrame, size: int = config.CHILD_SIZE, overlap: int = config.CHILD_OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """``parent_id, child_idx, content, metadata`` of parents (``parent_id, content, metadata``), with the columns ``keep``."""

    @F.arrow_udf("array<string>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([split_text(t, size, overlap) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    bound_batches(parent_rows.sparkSession)
    children = parent_rows.select("parent_id", "metadata", *keep, F.posexplode(cut("content")).alias("child_idx", "content"))
    return children.select("parent_id", *keep, "child_idx", "content", "metadata")


def fixed_windows(docs: DataFrame, text: str, size: int = config.CHILD_SIZE, overlap: int = config.CHILD_OVERLAP) -> DataFrame:
    """``docs`` without ``text`` but with ``chunk_idx, content``: windows of ``size`` characters, each ``size - overlap`` after the last."""
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    windows = docs.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0), last)))
    return windows.withColumn("content", F.substring(F.col(text), F.col("chunk_idx") * step + 1, F.lit(size))).select(*(c for c in docs.columns if c != text), "chunk_idx", "content")
