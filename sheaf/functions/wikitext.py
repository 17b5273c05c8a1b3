"""Wiki markup and page HTML to listings, items and mentions; parsers run in Arrow batches, one bad page costs only itself."""

from __future__ import annotations

import re
import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sheaf.session import materialize

META_SECTIONS = frozenset("see also|references|external links|further reading|notes|bibliography|sources|footnotes|citations|works cited|literature|gallery|notes and references|external sources".split("|"))
_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]")
_LANGUAGE = re.compile(r"^:?[a-z]{2,3}:(?=\S)")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_MARKED = re.compile(r"[<{\[&]|''")


def link_target(target: str) -> str:
    """Resource name of a link target: without language tag, fragment and outer spaces, first letter in upper case."""
    t = _LANGUAGE.sub("", target.strip()).lstrip(":").split("#", 1)[0].strip().replace(" ", "_")
    return t[:1].upper() + t[1:]


def plain(markup: str) -> str:
    """Text of markup: links as their labels; templates, references, tags and emphasis gone."""
    if not _MARKED.search(markup):
        return " ".join(markup.split())
    text = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", "", markup, flags=re.S)
    n = 1
    while n:  # innermost first
        text, n = re.subn(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\[\[(?:File|Image):[^\[\]]*\]\]", "", text)
    text = _LINK.sub(lambda m: m[2] if m[2] is not None else m[1], text)
    text = re.sub(r"'{2,}|</?[a-zA-Z][^>]*>", "", text)
    return re.sub(r"\s+", " ", unescape(text)).strip()


def first_link(markup: str) -> str | None:
    m = _LINK.search(markup)
    return link_target(m[1]) if m else None


def clean(markup: str) -> str:
    """Markup before parsing: non-breaking spaces, line breaks, references, sort names, column lists, quotes; enumerations inside tables gone."""
    text = markup.replace("&nbsp;", " ").replace("\xa0", " ")
    text = re.sub(r"<br\s*/?>", " ", text)
    text = re.sub(r"<ref[^>/]*/>|<ref[^>]*>.*?</ref>|<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"\{\{\s*sortname\s*\|([^|{}]*)\|([^|{}]*)(?:\|[^{}]*)?\}\}", lambda m: f"[[{m[1].strip()} {m[2].strip()}]]", text, flags=re.I)
    text = re.sub(r"\{\{\s*(?:div col|columns-list)[^{}]*?\|?\s*\n(.*?)\}\}", r"\n\1", text, flags=re.I | re.S)
    text = re.sub(r"\{\{\s*(?:unbulleted list|ubl|plainlist|flatlist)\s*\|([^{}]*)\}\}", lambda m: "\n" + "\n".join("* " + x.strip() for x in m[1].split("|") if x.strip()), text, flags=re.I)
    return re.sub(r"\{\|.*?\|\}", lambda t: re.sub(r"\n[*#]+ ?", " ", t[0]), text, flags=re.S)


def _mentions(markup: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """(tokens, [(start, stop, target)]) of one item: links located left to right."""
    tokens: list[str] = []
    found = []
    at = 0
    for m in _LINK.finditer(markup):
        tokens += _TOKEN.findall(plain(markup[at : m.start()]))
        label = _TOKEN.findall(plain(m[2] if m[2] is not None else m[1]))
        if label:
            found.append((len(tokens), len(tokens) + len(label), link_target(m[1])))
        tokens += label
        at = m.end()
    tokens += _TOKEN.findall(plain(markup[at:]))
    return tokens, found


def expand_mentions(tokens: list[str], taken: list[tuple[int, int, str]], lexicon: dict[str, list[tuple[list[str], str]]]) -> list[tuple[int, int, str]]:
    """More mentions by a page's own labels: at each free token the longest label that fits, never over another mention."""
    busy = [False] * len(tokens)
    for a, b, _ in taken:
        busy[a:b] = [True] * (b - a)
    out, i = list(taken), 0
    while i < len(tokens):
        for words, target in lexicon.get(tokens[i], ()):
            n = len(words)
            if tokens[i : i + n] == words and not any(busy[i : i + n]):
                out.append((i, i + n, target))
                busy[i : i + n] = [True] * n
                i += n - 1
                break
        i += 1
    return sorted(out)


def parse_page(title: str, markup: str) -> list[dict]:
    """Item rows of a page: enumerations of three entries or more and tables of three rows or more, with sections and mentions."""
    text = clean(markup)
    lexicon: dict[str, list[tuple[list[str], str]]] = {}
    for label, target in {**{m[2] if m[2] is not None else m[1]: link_target(m[1]) for m in _LINK.finditer(text)}, title.replace("_", " "): title}.items():
        words = _TOKEN.findall(plain(label))
        if words:
            lexicon.setdefault(words[0], []).append((words, target))
    for options in lexicon.values():
        options.sort(key=lambda x: (-len(x[0]), x[1]))
    rows: list[dict] = []
    top, section, listing, number = "", "", [], 0

    def flush() -> None:
        nonlocal listing, number
        if len(listing) >= 3 and section.lower() not in META_SECTIONS and top.lower() not in META_SECTIONS:
            for item, (kind, depth, cells) in enumerate(listing):
                for cell, part in enumerate(cells):
                    tokens, links = _mentions(part)
                    found = expand_mentions(tokens, links, lexicon)
                    rows.append({"listing": number, "kind": kind, "top_section": top, "section": section, "item": item, "cell": cell, "depth": depth, "tokens": tokens, "mentions": [{"start": a, "stop": b, "target": t} for a, b, t in found]})
            number += 1
        listing = []

    for block in re.split(r"(\{\|.*?\n\|\})", text, flags=re.S):
        if block.startswith("{|"):
            flush()
            table = []
            for raw in re.split(r"\n\|-[^\n]*", block[2:-2]):
                lines = [x for x in raw.split("\n") if x.startswith(("|", "!")) and not x.startswith(("|+", "|}"))]
                cells = [re.sub(r"^[^|\[\]]*\|(?!\|)", "", c).strip() for x in lines for c in re.split(r"\|\||!!", x[1:])]
                spans = any("rowspan" in x or "colspan" in x for x in lines)
                if 2 <= len(cells) <= 100 and not spans and not lines[0].startswith("!"):
                    table.append(("table", 1, cells))
            listing = table
            flush()
            continue
        for line in block.split("\n"):
            head = re.match(r"^(={2,6})\s*(.*?)\s*\1\s*$", line)
            entry = re.match(r"^([*#]+)\s*(.*)$", line)
            if head:
                flush()
                if len(head[1]) == 2:
                    top = plain(head[2])
                section = plain(head[2])
            elif entry:
                listing.append(("enum", len(entry[1]), [entry[2]]))
            elif line.strip():
                flush()
    flush()
    return rows


ITEMS = "page string, listing int, kind string, top_section string, section string, item int, cell int, depth int, tokens array<string>, mentions array<struct<start:int,stop:int,target:string>>"
#: Seconds a page may take, as in the pipeline this follows.
SECONDS = 60.0
#: Item rows that go into one Arrow batch, but for a page's own, which stay together.
BATCH_ROWS = 1000


class PageTimeout(Exception):
    pass


@contextmanager
def _at_most(seconds: float) -> Iterator[None]:
    """Raises PageTimeout when the block takes longer; where the interpreter allows no alarm (not the main thread) nothing is timed."""

    def stop(*_: object) -> None:
        raise PageTimeout

    if threading.current_thread() is not threading.main_thread():
        yield
        return
    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def parsed_pages(pages: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Item rows (see ITEMS) of pages (title, text) with a column ``error``; a page that can't be parsed, or not in time, has one row with only that.

    Pages with a null title or text have none. Rows leave in Arrow batches once there are BATCH_ROWS, so a task holds its largest page's and few others.
    """

    schema = to_arrow_schema(_parse_datatype_string(ITEMS + ", error string"))

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)
        rows: list[dict] = []
        for batch in parts:
            for title, text in zip(*batch.columns, strict=True):
                title, text = title.as_py(), text.as_py()  # noqa: PLW2901
                if text is None or title is None:
                    continue
                try:
                    with _at_most(seconds):
                        rows += [{"page": title, **r} for r in parse_page(title, text)]
                except (PageTimeout, RecursionError, ValueError, IndexError, KeyError) as e:
                    rows.append({"page": title, "error": type(e).__name__})
                if len(rows) >= BATCH_ROWS:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    return pages.select("title", "text").mapInArrow(work, ITEMS + ", error string")


def parse_pages(pages: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """Item rows (see ITEMS) of pages (title, text) that could be parsed."""
    return parsed_pages(pages, seconds).where("error IS NULL").drop("error")


def useful_pages(items: DataFrame, least: int = 3) -> DataFrame:
    """(page): pages with a listing of ``least`` items or more."""
    return items.groupBy("page", "listing").agg(F.countDistinct("item").alias("n")).where(F.col("n") >= least).select("page").distinct()


def html_items(pages: DataFrame) -> DataFrame:
    """(page_id, item, label, target) of the links in a page's lists, in order, by expressions alone."""
    entries = F.regexp_extract_all("html", F.lit(r"<li>\s*<a href=\"([^\"]*)\">([^<]*)</a>\s*</li>"), F.lit(0))
    return pages.select("page_id", F.posexplode(entries).alias("item", "li")).select(
        "page_id", "item", F.regexp_extract("li", r">([^<]+)</a>", 1).alias("label"), F.regexp_extract("li", r'href="([^"]*)"', 1).alias("target")
    )


def category_parents(pages: DataFrame) -> DataFrame:
    """(cat, parent) of the category links of category pages (title, text) with templates expanded already."""
    links = F.regexp_extract_all("text", F.lit(r"\[\[[Cc]ategory:([^\]\|#]+)"), F.lit(1))
    return pages.select(F.col("title").alias("cat"), F.explode(links).alias("p")).select("cat", F.concat(F.lit("Category:"), F.translate(F.trim("p"), " ", "_")).alias("parent")).where("cat <> parent").distinct()


_CALL = re.compile(r"\{\{([^{}]*)\}\}")
_REDIRECT = re.compile(r"#REDIRECT\s*\[\[Template:([^\]|]+)", re.I)


def template_key(name: str) -> str:
    return name.strip().replace(" ", "_").lower()


def _transcluded(body: str, args: list[str]) -> str:
    """A template's body as a page gets it: onlyinclude, noinclude and includeonly parts, parameters with defaults."""
    only = re.findall(r"<onlyinclude>(.*?)</onlyinclude>", body, re.S)
    body = "".join(only) if only else re.sub(r"</?includeonly>", "", re.sub(r"<noinclude>.*?</noinclude>", "", body, flags=re.S))
    given, n = {}, 0
    for a in args:
        k, eq, v = a.partition("=")
        if eq:
            given[k.strip()] = v.strip()
        else:
            n += 1
            given[str(n)] = a.strip()
    return re.sub(r"\{\{\{([^{}|]*)(?:\|([^{}]*))?\}\}\}", lambda p: given.get(p[1].strip(), p[2] or ""), body)


def expand_templates(text: str, templates: dict[str, str], seen: frozenset[str] = frozenset()) -> str:
    """Text with its templates put in, redirects followed; a template within itself gives nothing, and one that isn't there nothing."""
    out, done = [], 0
    while m := _CALL.search(text, done):
        name, *args = m[1].split("|")
        key = template_key(name)
        body = "" if key in seen else templates.get(key, "")
        if redirect := _REDIRECT.match(body):
            key = template_key(redirect[1])
            body = "" if key in seen else templates.get(key, "")
        new = expand_templates(_transcluded(body, args), templates, seen | {key}) if body else ""
        # what opens before this call may close after it: go on from the last open brace
        text = text[done : m.start()] + new + text[m.end() :]
        opened = text.rfind("{{", 0, m.start() - done)
        cut = opened if opened >= 0 else m.start() - done + len(new)
        out.append(text[:cut])
        text, done = text[cut:], 0
    return "".join(out) + text


def expanded_pages(pages: DataFrame, templates: DataFrame, rounds: int = 40) -> DataFrame:
    """``pages`` (title, text) with the templates (name, text) that they call put in.

    What each page may need, directly or through other templates, is found by joins, a round for each level of nesting, so neither table is
    collected; a page's own templates then are put in one batch of pages at a time. Pages deeper than ``rounds`` are an error.
    """
    key = lambda c: F.lower(F.regexp_replace(F.trim(c), " ", "_"))
    own = templates.where("name IS NOT NULL AND text IS NOT NULL").groupBy(key(F.col("name")).alias("key")).agg(F.min("text").alias("body"))
    calls = lambda c: F.array_distinct(F.transform(F.concat(F.regexp_extract_all(c, F.lit(r"\{\{([^{}|]+)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"(?i)#REDIRECT\s*\[\[Template:([^\]|]+)"), F.lit(1))), key))
    within = own.select(F.col("key").alias("caller"), F.explode(calls(F.col("body"))).alias("key"))
    needed = materialize(pages.where("text IS NOT NULL").select("title", F.explode(calls(F.col("text"))).alias("key")).distinct().join(own.select("key"), "key", "left_semi"), "calls")
    new = needed
    for _ in range(rounds):
        further = new.withColumnRenamed("key", "caller").join(within, "caller").select("title", "key").distinct().join(own.select("key"), "key", "left_semi")
        new = materialize(further.join(needed, ["title", "key"], "left_anti"), "calls")
        if new.isEmpty():
            break
        needed = materialize(needed.unionByName(new), "calls")
    else:
        raise RuntimeError("templates are nested too deeply")
    bodies = needed.join(own, "key").groupBy("title").agg(F.map_from_entries(F.collect_list(F.struct("key", "body"))).alias("bodies"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            texts = [t if t is None or "{{" not in t else expand_templates(t, b or {}) for t, b in zip(pdf["text"], pdf["bodies"], strict=True)]
            yield pd.DataFrame({"title": pdf["title"], "text": texts})

    return pages.select("title", "text").join(bodies, "title", "left").mapInPandas(work, "title string, text string")
