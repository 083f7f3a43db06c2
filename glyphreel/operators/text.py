"""Text that comes back from recognition: envelopes, markdown, boxes on a page."""

from __future__ import annotations

import html
import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphreel.functions import exprs as E

#: What trimming removes.
SPACE = "\t\n\v\f\r \u0085  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"


def bare_text(content: str) -> str:
    t = content.strip(SPACE)
    if t.startswith("```"):
        t = t.strip("`").strip(SPACE)
        t = t[4:].strip(SPACE) if t.startswith("json") else t
    return t


def envelope_text(content: str) -> str:
    """The text of a {"text", "lines"} object; what isn't one, by syntax or by type, is taken as it is."""
    t = bare_text(content)
    try:
        got = json.loads(t, parse_constant=lambda _: [][0])
    except (ValueError, IndexError, RecursionError):
        return t
    if got is None:
        return ""
    if not isinstance(got, dict):
        return t
    fields = {k.lower(): v for k, v in got.items()}
    text, lines = fields.get("text"), fields.get("lines")
    if not isinstance(text, str | None) or not isinstance(lines, list | None) or any(not isinstance(x, str | None) for x in lines or []):
        return t
    if text and text.strip(SPACE):
        return text.strip(SPACE)
    return f" {E.SEPARATOR} ".join(x or "" for x in lines).strip(SPACE) if lines else ""


def content_text(content: Any) -> str:
    """A message's content: a string, or parts with texts; anything else as it would print."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "\n".join(str(p["text"]) for p in content if isinstance(p, dict) and "text" in p)
    return "<nil>" if content is None else str(content)


@F.pandas_udf(T.StringType())
def envelope_udf(s: pd.Series) -> pd.Series:
    return s.map(envelope_text, na_action="ignore")


@F.pandas_udf(T.StringType())
def unescape_udf(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def markdown_text(markdown: Column | str) -> Column:
    return E.trim_space(unescape_udf(E.strip_tags(markdown)))


def box_bounds(boxes: Any, polys: Any, i: int) -> tuple[float, float, float, float] | None:
    """left, top, right, bottom from the box or else around the polygon."""
    if boxes is not None and i < len(boxes) and boxes[i] is not None and len(boxes[i]) >= 4:
        return tuple(float(v) for v in boxes[i][:4])
    if polys is not None and i < len(polys) and polys[i] is not None and len(polys[i]):
        pts = [p for p in polys[i] if len(p) >= 2]
        if len(polys[i][0]) < 2:
            raise ValueError("polygon point without two numbers")
        xs, ys = [float(p[0]) for p in pts], [float(p[1]) for p in pts]
        return min(xs), min(ys), max(xs), max(ys)
    return None


Box = tuple[str, float, float, float, float]


def text_boxes(texts: Any, boxes: Any, polys: Any) -> list[Box]:
    """Texts that aren't blank with their bounds; one without bounds is an error."""
    found = []
    for i, t in enumerate(texts if texts is not None else []):
        t = (t or "").strip(SPACE)
        if t:
            b = box_bounds(boxes, polys, i)
            if b is None:
                raise ValueError("recognised text without geometry")
            found.append((t, *b))
    return found


def rebuild_lines(boxes: list[Box]) -> list[str]:
    """Lines of boxes from top to bottom. Order: top, or left where tops differ by one pixel or less (insertion by
    that rule, ties by place in the input). A box joins the last line if the centres are near."""
    order: list[Box] = []
    for b in boxes:
        at = len(order)
        while at and ((b[2] < order[at - 1][2]) if abs(b[2] - order[at - 1][2]) > 1 else b[1] < order[at - 1][1]):
            at -= 1
        order.insert(at, b)
    if not order:
        return []
    near = max(4.0, 0.5 * sum(max(1.0, b[4] - b[2]) for b in order) / len(order))
    lines: list[list[Box]] = []
    for b in order:
        if lines:
            top, low = min(x[2] for x in lines[-1]), max(x[4] for x in lines[-1])
            if abs((b[2] + b[4]) / 2 - (top + low) / 2) <= near:
                lines[-1].append(b)
                continue
        lines.append([b])
    out = []
    for line in lines:
        line.sort(key=lambda b: b[1])
        text = line[0][0]
        for a, b in zip(line, line[1:], strict=False):
            text += (" " if b[1] - a[3] > max(6.0, 0.25 * (a[3] - a[1])) else "") + b[0]
        out.append(text.strip(SPACE))
    return out


def page_lines(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, line for pages with rec_texts, rec_boxes, dt_polys; an error fails the task as a page fails the sheet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for r in df.itertuples(index=False):
                for n, line in enumerate(rebuild_lines(text_boxes(r.rec_texts, r.rec_boxes, r.dt_polys)), 1):
                    rows.append((*(getattr(r, k) for k in keys), n, line))
            yield pd.DataFrame(rows, columns=[*keys, "line_no", "line"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keys)
    return pages.select(*keys, "rec_texts", "rec_boxes", "dt_polys").mapInPandas(run, f"{kinds}, line_no int, line string")


def page_text(pruned: list[dict]) -> str:
    """Texts of pages, blank ones skipped, an empty line between."""
    parts = ["\n\n".join(rebuild_lines(text_boxes(p.get("rec_texts"), p.get("rec_boxes"), p.get("dt_polys")))).strip(SPACE) for p in pruned]
    return "\n\n".join(p for p in parts if p)


def markdown_plain(markdown: str) -> str:
    import re

    return html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"(?i)</(?:td|th|tr|p|div|li)>", "\n", markdown))).strip(SPACE)


def is_finite(*values: float) -> bool:
    return all(math.isfinite(v) for v in values)
