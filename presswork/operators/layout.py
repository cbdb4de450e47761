"""Page geometry: glyphs to lines, lines to columns, titles and articles.

A page is small and bounded; what is order-dependent within it (column splits, title merging) runs
in Python over batches of whole pages, everything else as DataFrame operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswork.functions import text as tx

PAGE = ["doc_id", "page"]


def split_lines(glyphs: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, line_no, part, text, x0, y0, x1, y1, max_size from glyphs: a line is cut where
    the gap to the glyph before is wider than twice the mean positive width (5 if there is none)
    and 2 % of the page."""
    line = [*PAGE, "line_no"]
    w = Window.partitionBy(*line).orderBy("x", "seq")
    whole = Window.partitionBy(*line)
    d = glyphs.join(pages.select(*PAGE, "width"), PAGE)
    mean = F.coalesce(F.avg(F.when(F.col("w") > 0, F.col("w"))).over(whole), F.lit(5.0))
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    d = d.withColumns({"limit": F.greatest(mean * 2, F.col("width") * 0.02), "gap": gap})
    d = d.withColumn("part", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(w).cast("bigint"))
    chars = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "ch"))), lambda x: x["ch"]), "")
    return d.groupBy(*line, "part").agg(
        tx.squeeze(chars).alias("text"),
        F.min("x").alias("x0"),
        F.min(F.col("y") - F.col("h")).alias("y0"),
        F.max(F.col("x") + F.col("w")).alias("x1"),
        F.max("y").alias("y1"),
        F.max("font_size").alias("max_size"),
    )


def upper_median(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, median: the upper one of the two middle values.

    Values are counted per key first, so only distinct values meet in one group."""
    n = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(col)
    n = n.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*keys))})
    return n.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(col).alias("median"))


def gap_candidates(points: DataFrame, keys: list[str], col: str, k: int = 6) -> DataFrame:
    """keys, gap, at: the k widest gaps between neighbouring values; ties by position."""
    w = Window.partitionBy(*keys).orderBy(col)
    d = points.withColumns({"gap": F.lead(col).over(w) - F.col(col), "pos": F.row_number().over(w)}).filter("gap is not null")
    top = Window.partitionBy(*keys).orderBy(F.col("gap").desc(), "pos")
    return d.withColumn("rank", F.row_number().over(top).cast("bigint")).filter(F.col("rank") <= k).select(*keys, "gap", F.col(col).alias("at"), "rank")


def column_splits(xs: list[float], width: float) -> list[float]:
    """At most two x positions that part the columns; none for fewer than 8 points."""
    if len(xs) < 8:
        return []
    s = sorted(xs)
    widest = sorted(range(len(s) - 1), key=lambda i: -(s[i + 1] - s[i]))[:6]
    got: list[float] = []
    for i in widest:
        if s[i + 1] - s[i] < 0.10 * width or len(got) == 2:
            break
        at = (s[i] + s[i + 1]) / 2
        left = sum(x < at for x in s)
        if min(left, len(s) - left) >= 4 and all(abs(at - g) >= 0.05 * width for g in got):
            got.append(at)
    return sorted(got)


def column_of(x: float, splits: list[float]) -> int:
    return sum(s <= x for s in splits)


def _fits_title(a: dict, b: dict, median: float, width: float) -> bool:
    """Whether b goes on with the headline a above it."""
    gap = b["y0"] - a["y1"]
    big, small = max(a["max_size"], b["max_size"]), min(a["max_size"], b["max_size"])
    narrow = min(a["x1"] - a["x0"], b["x1"] - b["x0"])
    shared = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
    centre = abs((a["x0"] + a["x1"]) - (b["x0"] + b["x1"])) / 2
    return -14 <= gap <= max(18.0, 1.3 * median) and small >= max(1.35 * median, 13.5) and centre <= 0.18 * width and narrow > 0 and shared / narrow >= 0.30 and big > 0 and (big - small) / big <= 0.30


def merge_titles(titles: list[dict], median: float, width: float) -> list[dict]:
    """Headlines of several lines as one, each taking the closest line below that fits."""
    order = lambda t: (t["y0"], t["x0"])
    waiting, done = sorted(titles, key=order), []
    far = max(36.0, 2.4 * median)
    while waiting:
        cur = waiting.pop(0)
        while True:
            near = []
            for n, t in enumerate(waiting):
                gap = t["y0"] - cur["y1"]
                if gap > far:
                    break
                if _fits_title(cur, t, median, width):
                    near.append((gap, n))
            if not near:
                break
            t = waiting.pop(min(near)[1])
            cur = {
                "text": re.sub(r"\s+", " ", cur["text"] + " " + t["text"]).strip(),
                **{c: min(cur[c], t[c]) for c in ("x0", "y0")},
                **{c: max(cur[c], t[c]) for c in ("x1", "y1", "max_size")},
            }
        done.append(cur)
    return sorted(done, key=order)


def reading_order(lines: list[dict], width: float) -> list[dict]:
    """By column, then from top to bottom; two lines or fewer have no columns."""
    splits = column_splits([x["x0"] for x in lines], width) if len(lines) > 2 else []
    return sorted(lines, key=lambda x: (column_of((x["x0"] + x["x1"]) / 2, splits), x["y0"], x["x0"]))


def page_articles(lines: list[dict], sizes: list[float], titles: list[dict], width: float, height: float) -> list[dict]:
    """Articles of a page from its lines, glyph sizes and headline lines."""
    if not lines or not sizes or not titles:
        return []
    median = sorted(sizes)[len(sizes) // 2]
    titles = merge_titles(titles, median, width)
    source = titles if len(titles) >= 8 else lines
    splits = column_splits([t["x0"] for t in source], width)
    edges, margin = [0.0, *splits, width], 0.05 * width
    centre = lambda t: (t["x0"] + t["x1"]) / 2
    out = []
    for c in range(len(splits) + 1):
        column = [t for t in titles if column_of(centre(t), splits) == c]
        for n, t in enumerate(column):
            below = next((u["y0"] - 2 for u in column[n + 1 :] if abs(centre(u) - centre(t)) <= 0.22 * width), height)
            if below <= t["y1"] + 22:
                continue
            wide = t["x1"] - t["x0"] > 0.4 * width
            x0, x1 = (t["x0"], t["x1"]) if wide else (edges[c], edges[c + 1])
            box = (max(0.0, x0 - margin), max(0.0, t["y1"]), min(width, x1 + margin), min(height, below))
            inside = [x for x in lines if box[0] <= centre(x) <= box[2] and box[1] <= (x["y0"] + x["y1"]) / 2 <= box[3]]
            body = "\n".join(x["text"] for x in reading_order(inside, width)).strip()
            if len(body) < 30:
                continue
            on = re.search(tx.CONTINUED, body)
            title = re.sub(tx.PAGE_NUMBER, "", t["text"]).strip()
            out.append({"title": title, "text": body, "y": t["y0"], "x": t["x0"], "column_index": c, "continuation_to_page": int(on[1]) if on else None})
    return sorted(out, key=lambda a: (a["y"], a["x"]))


def articles(lines: DataFrame, glyph_sizes: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, idx, id, title, text, column_index, continuation_to_page.

    lines: doc_id, page, text, x0, y0, x1, y1, max_size; glyph_sizes: doc_id, page, font_size;
    pages: doc_id, page, width, height. Pages without lines or headlines give nothing."""
    med = upper_median(glyph_sizes, PAGE, "font_size")
    d = lines.join(med, PAGE).join(pages, PAGE)
    d = d.withColumn("is_title", F.coalesce(tx.is_probable_title(F.col("text"), F.col("max_size"), F.col("median")), F.lit(False)))

    cols = ["text", "x0", "y0", "x1", "y1", "max_size"]
    rows = F.array_sort(F.collect_list(F.struct("y0", "x0", "text", "x1", "y1", "max_size", "is_title")))
    whole = d.groupBy(*PAGE, "median", "width", "height").agg(rows.alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                lines = [{c: x[c] for c in cols} for x in r.rows]
                titles = [n for n, x in zip(lines, r.rows) if x["is_title"]]
                for n, a in enumerate(page_articles(lines, [r.median], titles, r.width, r.height), 1):
                    out.append((r.doc_id, r.page, n, f"p{int(r.page):02d}_a{n:03d}", a["title"], a["text"], a["column_index"], a["continuation_to_page"]))
            yield pd.DataFrame(out, columns=["doc_id", "page", "idx", "id", "title", "text", "column_index", "continuation_to_page"]).astype({"continuation_to_page": "Int32"})

    return whole.mapInPandas(run, "doc_id bigint, page int, idx int, id string, title string, text string, column_index int, continuation_to_page int")


def in_reading_order(lines: DataFrame, key: str, width: float) -> DataFrame:
    """key, line_id, n, col: lines of a page in reading order with their column."""
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "line_id", "x1"))).alias("rows"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, rows in zip(f[key], f["rows"]):
                page = [{c: x[c] for c in ("line_id", "x0", "y0", "x1")} for x in rows]
                splits = column_splits([x["x0"] for x in page], width)
                out += [(k, x["line_id"], n, column_of((x["x0"] + x["x1"]) / 2, splits)) for n, x in enumerate(reading_order(page, width), 1)]
            yield pd.DataFrame(out, columns=[key, "line_id", "n", "col"])

    return whole.mapInPandas(run, f"{key} bigint, line_id string, n bigint, col bigint")


def body_lines(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """Lines whose centre lies in a box of their page, edges included; a line may be in several.

    An equi join on the page with the range as its condition, never over all pages."""
    cx, cy = (F.col("l.x0") + F.col("l.x1")) / 2, (F.col("l.y0") + F.col("l.y1")) / 2
    on = (F.col("l.doc_id") == F.col("b.doc_id")) & (F.col("l.page") == F.col("b.page")) & cx.between(F.col("b.x0"), F.col("b.x1")) & cy.between(F.col("b.y0"), F.col("b.y1"))
    return lines.alias("l").join(boxes.alias("b"), on).select("l.doc_id", "l.page", "b.box_id", "l.line_id", "l.text")


def joined_text(df: DataFrame, keys: list[str], order: str, col: str, sep: str = "\n") -> DataFrame:
    """keys, text: the strings of a group in order."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(col).alias("t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x["t"]), sep).alias("text"))


def next_title(titles: DataFrame, share: float = 0.22) -> DataFrame:
    """title_id, body_bottom: 2 above the first later title of the column whose centre is within
    ``share`` of the page width, else the page height."""
    a, b = titles.alias("a"), titles.alias("b")
    ca, cb = (F.col("a.x0") + F.col("a.x1")) / 2, (F.col("b.x0") + F.col("b.x1")) / 2
    later = (F.col("b.y0") > F.col("a.y0")) | ((F.col("b.y0") == F.col("a.y0")) & (F.col("b.title_id") > F.col("a.title_id")))
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page") == F.col("b.page")) & later & (F.abs(ca - cb) <= F.col("a.width") * share)
    low = a.join(b, on, "left").groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.title_id").alias("title_id"), F.col("a.height").alias("height"))
    return low.agg(F.min("b.y0").alias("next_y")).select("doc_id", "title_id", F.coalesce(F.col("next_y") - 2, F.col("height")).alias("body_bottom"))


def image_boxes(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Boxes with y turned to run downwards."""
    d = images.join(pages.select(*PAGE, "height"), PAGE)
    return d.select(*PAGE, "image_id", F.col("x").alias("x0"), (F.col("height") - F.col("y") - F.col("h")).alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("height") - F.col("y")).alias("y1"))


def numbered(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` with n, counting from 1 in each group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
