"""Posts written by a model: footnotes, charts and an HTML page, made on the driver from one Markdown text.

A post is cut into blocks first (fences, then stretches between blank lines); each kind of block has its rendering.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from pathlib import Path

NOTE = re.compile(r"\[\^(?P<key>[^\]\s]+)\]:[ \t]*(?P<text>.*)")
FENCE = re.compile(r"^```[ \t]*(?P<info>[^\n`]*)\n(?P<body>.*?)(?:^```[ \t]*$|\Z)", re.M | re.S)
MARKED = re.compile(r"`(?P<code>[^`]+)`|\*\*(?P<strong>.+?)\*\*|\*(?P<em>[^*\s][^*]*)\*|\[\^(?P<sup>[^\]\s]+)\]")
ITEM = re.compile(r"(?:(?P<bullet>[-*+])|\d+\.)\s+(?P<text>.*)")
#: The fence of a chart configuration.
CHART = "chartjs"


def blocks(text: str) -> Iterator[tuple[str, str]]:
    """``(kind, body)`` in order; kind is the info word of a fence after ``fence:``, otherwise ``text``."""
    at = 0
    for fence in FENCE.finditer(text):
        yield from (("text", part) for part in re.split(r"\n[ \t]*\n", text[at : fence.start()]) if part.strip())
        yield "fence:" + fence["info"].strip(), fence["body"].rstrip("\n")
        at = fence.end()
    yield from (("text", part) for part in re.split(r"\n[ \t]*\n", text[at:]) if part.strip())


def footnotes(text: str) -> list[tuple[str, str]]:
    """Definitions ``[^key]: text`` in order of their numbers, other keys after them by name."""
    lines = (line for kind, body in blocks(text) if kind == "text" for line in body.splitlines())
    found = {m["key"]: m["text"] for m in map(NOTE.fullmatch, map(str.strip, lines)) if m}
    return sorted(found.items(), key=lambda kv: (0, int(kv[0]), "") if kv[0].isdecimal() else (1, 0, kv[0]))


def chart(body: str) -> dict | None:
    """A chart configuration; None where it is no JSON object."""
    try:
        config = json.loads(body)
    except ValueError:
        return None
    return config if isinstance(config, dict) else None


def charts(text: str) -> list[dict]:
    """The chart configurations of a post; what is no JSON object is left out."""
    return [c for kind, body in blocks(text) if kind == f"fence:{CHART}" and (c := chart(body)) is not None]


def marked(text: str) -> str:
    """Escaped text with its spans of code, stress and footnote references."""

    def span(m: re.Match) -> str:
        tag, inner = m.lastgroup, m[m.lastgroup]
        if tag == "sup":
            inner = f'<a href="#note-{inner}">{inner}</a>'
        return f"<{tag}>{inner}</{tag}>"

    return MARKED.sub(span, html.escape(text, quote=False))


def _listing(lines: list[str]) -> str | None:
    items = [ITEM.fullmatch(line.strip()) for line in lines]
    if not all(items):
        return None
    tag = "ul" if items[0]["bullet"] else "ol"
    return f"<{tag}>" + "".join(f"<li>{marked(m['text'])}</li>" for m in items) + f"</{tag}>"


def _grid(lines: list[str]) -> str | None:
    rows = [[cell.strip() for cell in line.strip().removeprefix("|").removesuffix("|").split("|")] for line in lines]
    if len(rows) < 2 or "|" not in lines[0] or any(set(cell) - set("-: ") or "-" not in cell for cell in rows[1]):
        return None
    made = ["".join(f"<{tag}>{marked(cell)}</{tag}>" for cell in row) for tag, row in [("th", rows[0]), *(("td", r) for r in rows[2:])]]
    return "<table>" + "".join(f"<tr>{row}</tr>" for row in made) + "</table>"


def _prose(lines: list[str]) -> str:
    out = []
    for line in lines:
        if heading := re.fullmatch(r"(#{1,6})\s+(.*)", line):
            out.append(f"<h{len(heading[1])}>{marked(heading[2])}</h{len(heading[1])}>")
        elif not NOTE.fullmatch(line.strip()):
            out.append(f"<p>{marked(line)}</p>")
    return "\n".join(out)


def post_body(text: str) -> str:
    """The post as HTML; charts become numbered canvases, footnotes stand at the end."""
    out, n_charts = [], 0
    for kind, body in blocks(text):
        lines = body.splitlines()
        if kind == "text":
            out.append(_listing(lines) or _grid(lines) or _prose(lines))
        elif kind == f"fence:{CHART}" and chart(body) is not None:
            out.append(f'<canvas id="chart-{n_charts}"></canvas>')
            n_charts += 1
        else:
            out.append(f"<pre><code>{html.escape(body, quote=False)}</code></pre>")
    notes = [f'<li id="note-{html.escape(key)}" value="{html.escape(key)}">{marked(note)}</li>' for key, note in footnotes(text)]
    if notes:
        out.append(f"<ol class=\"notes\">{''.join(notes)}</ol>")
    return "\n".join(x for x in out if x)


def post_page(text: str, topic: str = "") -> str:
    """A whole page, titled by the post's first heading; chart data lies beside it as JSON."""
    heading = re.search(r"^#\s+(.+)$", text, re.M)
    title = html.escape(heading[1].strip() if heading else f"{topic} post".strip())
    data = json.dumps(charts(text), ensure_ascii=False).replace("</", "<\\/")
    head = f'<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<title>{title}</title>\n</head>\n'
    return f'{head}<body>\n{post_body(text)}\n<script type="application/json" id="charts">{data}</script>\n</body>\n</html>\n'


def export_post(text: str, folder: str, topic: str) -> list[str]:
    """Writes the post as Markdown and as a page; returns both paths."""
    stem = re.sub(r"[^A-Za-z0-9_-]", "_", topic or "post")
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    paths = [base / f"{stem}_post.md", base / f"{stem}_post.html"]
    for path, content in zip(paths, (text, post_page(text, topic))):
        path.write_text(content, encoding="utf-8")
    return [str(p) for p in paths]
