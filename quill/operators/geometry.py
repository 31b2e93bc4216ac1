"""Page geometry: text items to lines, labelled entries with indented continuations. A line is compared with the first
item of its group, so grouping carries state; a page is one call, pages are independent."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
LABEL = re.compile(r"^(\(?\d+[a-z]?\)|[a-z]\.|[ivxlcdm]+\.)\s+", re.I)
PAGE_NUMBER = re.compile(r"^-?\s*\d+\s*-?$")
Y_TOLERANCE, INDENT = 3.0, 10.0


def page_lines(items: list[tuple[str, float, float]], tolerance: float = Y_TOLERANCE) -> list[tuple[str, float, float]]:
    """(text, x, y) lines of (text, x, y) items, top to bottom; page numbers are left out."""
    left = sorted((y, x, " ".join(t.split())) for t, x, y in items if t and t.strip())
    lines, group = [], []
    for item in [*left, None]:
        if group and (item is None or abs(group[0][0] - item[0]) > tolerance):
            group.sort(key=lambda g: g[1])
            text = " ".join(g[2] for g in group)
            if not PAGE_NUMBER.match(text.strip("- ")):
                lines.append((text, group[0][1], sum(g[0] for g in group) / len(group)))
            group = []
        if item:
            group.append(item)
    return lines


def entries(lines: list[tuple[str, float, float]]) -> list[tuple[str, str, float, float]]:
    """(label, text, first y, last y): a labelled line and the lines indented under it that follow at once."""
    out: list[list] = []
    inside = False
    for text, x, y in lines:
        m = LABEL.match(text)
        if m:
            out.append([m[1].lower(), [text], x, y, y])
            inside = True
        elif inside and x >= out[-1][2] + INDENT:
            out[-1][1].append(text)
            out[-1][4] = y
        else:
            inside = False
    return [(a, " ".join(t), y0, y1) for a, t, _, y0, y1 in out]


def labels_in(text: str) -> list[str]:
    return [m[1].lower() for m in re.finditer(r"(?<!\w)(\(?\d+[a-z]?\)|[a-z]\.|[ivxlcdm]+\.)\s+", text, re.I)]


def block_text(text: str, found: list[tuple[str, str, float, float]]) -> str | None:
    """The entries whose labels are those of the text, in order and side by side."""
    labels = labels_in(text)
    for i in range(len(found) - len(labels) + 1) if labels else ():
        if [e[0] for e in found[i : i + len(labels)]] == labels:
            return "; ".join(e[1] for e in found[i : i + len(labels)]).strip(" ;")
    return None


def page_entries(items: DataFrame) -> DataFrame:
    """items: file_id, page_num, text, x, y. Items lie sorted by page and place in a task; those of one height are put
    together before they are looked at, and a page is one call as its last item goes by."""
    rows = items.select(F.col("file_id").cast("string").alias("file_id"), F.col("page_num").cast("int").alias("page_num"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "text")
    out = pa.schema([("file_id", pa.string()), ("page_num", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("first_y", pa.float64()), ("last_y", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, heights, found = None, [], []
        for b in batches:
            ends = heads(b)
            firsts = b.select(["file_id", "page_num", "y"]).take(pa.array([0, *ends[:-1]], pa.int64())) if ends else b.select(["file_id", "page_num", "y"])
            files, pages, y = (firsts.column(c).to_pylist() for c in ("file_id", "page_num", "y"))
            x, text = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("x", "text"))
            start = 0
            for at, end in enumerate(ends):
                here = (files[at], pages[at])
                if heights and page != here:
                    found += [(*page, *e) for e in entries(sorted_lines(heights))]
                    heights = []
                page = here
                heights.append((y[at], list(zip(x[start:end], text[start:end], strict=True))))
                start = end
            if len(found) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)
                found = []
        if heights:
            found += [(*page, *e) for e in entries(sorted_lines(heights))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    def heads(b: pa.RecordBatch) -> list[int]:
        """Where a batch's runs of items of one page and height end."""
        n = b.num_rows
        if not n:
            return []
        other = np.zeros(n - 1, bool)
        for name in ("file_id", "page_num", "y"):
            c = b.column(name)
            same = pc.equal(c.slice(1), c.slice(0, n - 1)).fill_null(False)
            both_null = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
            other |= ~pc.or_(same, both_null).to_numpy(zero_copy_only=False)
        return [*(np.flatnonzero(other) + 1).tolist(), n]

    return rows.repartition("file_id", "page_num").sortWithinPartitions("file_id", "page_num", "y", "x").mapInArrow(run, "file_id string, page_num int, label string, text string, first_y double, last_y double")


def sorted_lines(heights: list[tuple[float, list[tuple[float, str]]]], tolerance: float = Y_TOLERANCE) -> list[tuple[str, float, float]]:
    """page_lines() of items that come as (y, [(x, text)]) in ascending order of y and x. A height may come in two pieces."""
    lines, group = [], []
    for height in [*heights, None]:
        items = height and [(x, t) for x, t in height[1] if t and t.strip()]
        if height and not items:
            continue
        if group and (height is None or abs(group[0][0] - height[0]) > tolerance):
            ys = [y for y, held in group for _ in held]
            placed = [(x, t) for _, held in group for x, t in held]
            xs = [x for x, _ in placed]
            if len(group) > 1 or len(set(xs)) < len(xs):  # as page_lines() has them: by height, place and words, then by place
                placed = [(x, t) for _, x, t in sorted((y, x, " ".join(t.split())) for y, held in group for x, t in held)]
                placed.sort(key=lambda i: i[0])
            text = " ".join(" ".join([t for _, t in placed]).split())
            if not PAGE_NUMBER.match(text.strip("- ")):
                lines.append((text, placed[0][0], sum(ys) / len(ys)))
            group = []
        if height:
            group.append((height[0], items))
    return lines


def matched_blocks(blocks: DataFrame, key: str, block: str, lines: str) -> DataFrame:
    """blocks: key, a block's text, and its page's labelled lines (an array). (key, labels by commas, text of the entries)."""

    def run(batches):
        for pdf in batches:
            found = [entries([(x, 0.0, float(i)) for i, x in enumerate(ls)]) for ls in pdf[lines]]
            yield pd.DataFrame({key: pdf[key], "labels": [",".join(labels_in(b)) for b in pdf[block]], "text": [block_text(b, f) for b, f in zip(pdf[block], found, strict=True)]})

    return blocks.select(key, block, lines).mapInPandas(run, f"`{key}` long, labels string, text string")
