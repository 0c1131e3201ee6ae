"""Text functions: cleaning, shapes of paths and names, masking, packed JSON, visible text of pages, chunks.

Where Spark's functions express a rule it stays in them. The few rules that decode or parse in loops are plain Python
functions with a pandas UDF around each (``*_udf``); they get null for rows that need none of it.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from functools import cache
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def _udf(fn, kind: str = "string"):
    """A pandas UDF of a function of one text; null stays null."""

    @cache
    def made():
        return F.pandas_udf(lambda s: s.map(lambda x: None if x is None else fn(x)).astype(object), kind)

    return lambda column: made()(column)


# --- cleaning ------------------------------------------------------------------------------------------------------------


def _instance(text: str) -> str:
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text).strip().casefold())


def instance_name(text: Column) -> Column:
    """A name in compatibility form, case-folded, without white space. ASCII needs no Python."""
    ascii_ = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(ascii_, F.lower(F.regexp_replace(text, r"[\s\x1c-\x1f]+", ""))).otherwise(_udf(_instance)(F.when(~ascii_, text)))


def clean_text(text: Column) -> Column:
    """A text without outer white space; empty for null and for words that stand for it."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.lower(t).isin("", "nan", "none", "null", "<na>"), "").otherwise(F.coalesce(t, F.lit("")))


def clean_port(text: Column) -> Column:
    """A port of 0 to 65535 that may be written as a whole decimal; null for any other text."""
    number = clean_text(text).try_cast("double")
    return F.when((number == F.floor(number)) & number.between(0, 65535), number.cast("int"))


def packed_digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9a-fA-F]", "")


def _printable(text: str) -> str | None:
    most = max(1, len(text))
    if text.count("�") > most / 100:
        return None
    return text if sum(c.isprintable() or c in "\r\n\t" for c in text) / most >= 0.65 else None


def hex_text(value: Column) -> Column:
    """The text of a payload in hexadecimal, if it is UTF-8 but for one character in 100 and printable to two thirds (0.65)."""
    digits = packed_digits(value)
    fits = (F.length(digits) > 0) & (F.length(digits) % 2 == 0) & (F.length(digits) <= 131_072)
    return _udf(lambda d: _printable(bytes.fromhex(d).decode("utf-8", "replace")))(F.when(fits, digits))


# --- shapes --------------------------------------------------------------------------------------------------------------

#: What a value, a key and a path segment are reduced to.
VALUE_SHAPES = ("<NUM>", "<SQL_EXPR>", "<SCRIPT_EXPR>", "<PATH_TRAVERSAL>", "<EMPTY>", "<TEXT>")
KEY_SHAPES = {
    "<COMMAND_PARAM>": ("cmd", "command", "exec", "execute"),
    "<FILE_PARAM>": ("file", "filename", "upload"),
    "<CREDENTIAL_PARAM>": ("user", "username", "pass", "password"),
    "<QUERY_PARAM>": ("id", "query", "search"),
    "<PARAM>": (),
}
SEGMENT_SHAPES = ("<SEG>", "<NUM>", "<ID>", "<APP>", "<ROUTE>")
QUERY_WORDS = (" union ", " select ", " or ", " and ", "--", "'", '"')
SCRIPT_WORDS = ("<script", "javascript:", "onerror=", "onload=")
PUBLIC_SUFFIXES = ("local", "arpa", "com", "org", "net", "edu", "io")
_KEY_OF = {name: shape for shape, names in KEY_SHAPES.items() for name in (*names, shape.lower())}


def decoded(text: str) -> str:
    """Percent-decoded up to three times, control characters as spaces."""
    for _ in range(3):
        if (text := unquote(before := text)) == before:
            break
    return CONTROL.sub(" ", text).strip()


def value_shape(text: str) -> str:
    value = decoded(text)
    low = value.casefold()
    if value.upper() in VALUE_SHAPES:
        return value.upper()
    tests = (
        ("<NUM>", re.fullmatch(r"[-+]?\d+(?:\.\d+)?", value)), ("<SQL_EXPR>", any(w in low for w in QUERY_WORDS)),
        ("<SCRIPT_EXPR>", any(w in low for w in SCRIPT_WORDS)), ("<PATH_TRAVERSAL>", re.search(r"\.\./|%2e%2e", low)), ("<EMPTY>", not value),
    )
    return next((shape for shape, hit in tests if hit), "<TEXT>")


def key_shape(text: str) -> str:
    return _KEY_OF.get(decoded(text).casefold(), "<PARAM>")


def segment_shape(text: str) -> str:
    s = decoded(text)
    if s.upper() in SEGMENT_SHAPES:
        return s.upper()
    if s in (".", ".."):
        return s
    if s.isdigit():
        return "<NUM>"
    if re.fullmatch(r"(?i)[0-9a-f-]{16,}", s):
        return "<ID>"
    stem, dot, ending = s.rpartition(".")
    known = re.fullmatch(r"(?i)<FILE>\.[a-z0-9]{1,8}", s)
    return f"<FILE>.{ending.lower()}" if known or dot and len(ending) <= 8 else "<SEG>"


def uri_shape(text: str) -> str:
    """The shape of a request target: of each segment, and of each parameter's key and value."""
    try:
        parts = urlsplit(text)
    except ValueError:
        return "<INVALID_URI>"
    path = "/" + "/".join(segment_shape(s) for s in parts.path.split("/") if s)
    query = "&".join(f"{key_shape(k)}={value_shape(v)}" for k, v in parse_qsl(parts.query, keep_blank_values=True))
    return f"{path}?{query}" if query else path


uri_shape_udf = _udf(uri_shape)
parameter_count_udf = _udf(lambda t: len(parse_qsl(urlsplit(t).query, keep_blank_values=True)), "int")


def name_shape(text: Column) -> Column:
    """A host name but for a public suffix."""
    last = F.lower(F.regexp_extract(text, r"([^.]+)\.*$", 1))
    return F.when(last.isin(*PUBLIC_SUFFIXES), F.concat(F.lit("<HOST>."), last)).otherwise("<HOST>")


# --- masking -------------------------------------------------------------------------------------------------------------

#: What is masked in a payload, in this order, each as pattern and replacement.
MASKS = [
    (r"(?im)^(authorization|cookie|set-cookie):\s*[^\r\n]+", "$1: <SECRET>"),
    (r"(?im)^(host|origin|referer):\s*[^\r\n]+", "$1: <HOST>"),
    (r"(?im)^user-agent:\s*[^\r\n]+", "User-Agent: <CLIENT>"),
    (r"(?i)\b(?:sqlmap|nikto|hydra|nmap|metasploit|msfconsole)(?:[/ _-][\w.-]+)?\b", "<AUTOMATION_TOOL>"),
    (r"(?i)\b(?:digininja|randomstorm(?:\.png)?|github\.com|microsoft\s+odbc\s+sql\s+server\s+driver)\b", "<ENVIRONMENT>"),
    (r"(?i)(?:incorrect[_ ]syntax[_ ]near[_ ][^\s<]+|odbc[_ ]sql[_ ]server[_ ]driver|sql[_ ]server)", "<DATABASE_ERROR>"),
    (r"(?<!\d)(?:\d{1,3}\.){3}\d{1,3}(?!\d)", "<IP>"),
    (r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:])", "<IPV6>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<UUID>"),
    (r"(?i)\b(?:\d{4}-\d{2}-\d{2}[T ][0-9:.+-]+|(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+\d{1,2}\s+[A-Z][a-z]{2}\s+\d{4}\s+[0-9:]+\s+GMT)\b", "<TIME>"),
    (r"(?i)\b(?:[0-9a-f]{24,}|[a-z0-9_-]{36,})\b", "<TOKEN>"),
    (r"(?i)/(?:dvwa|vulnerabilities|mutillidae|testbed|home/pi|var/www)(?:/[^?\s]*)?", "/<APP>/<ROUTE>"),
    *[(rf"(?i)\b[a-z0-9_-]+\.{e}\b", f"<FILE>.{e}") for e in ("jsp", "php", "aspx", "asp", "html", "htm")],
    (r"(?i)(?<![a-z0-9])E\d{3,6}(?![a-z0-9])", "<ERROR_CODE>"),
    (r"(?i)(?<![a-z0-9])fname(?![a-z0-9])", "<PARAMETER>"),
    (r"(?i)boundary=([-_a-z0-9.]{8,})", "boundary=<BOUNDARY>"),
    (r'(?i)filename="?[^";\r\n]+(\.[a-z0-9]{1,8})"?', 'filename="<FILE>$1"'),
    (r"(?i)\b(device|client|session|token|userid|username)=([^&\s]+)", "$1=<ID>"),
    *[(rf"(?i)(^|[&\s])(?:{'|'.join(names)})=", f"$1{shape}=") for shape, names in KEY_SHAPES.items() if names],
    (r"(?i)(^|[&\s])[a-z][a-z0-9_-]{0,40}=", "$1<PARAM>="),
    (r"[ \t]+", " "),
    (r"\n{3,}", "\n\n"),
    (r"^\s+|\s+$", ""),
]
#: The header fields that a masked request keeps, and as what.
HEADERS = {"content-type": None, "content-length": None} | dict.fromkeys(("host", "origin", "referer"), "<HOST>") | dict.fromkeys(("authorization", "cookie", "set-cookie"), "<SECRET>")
REQUEST = re.compile(r"(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+(\S+)\s+(HTTP/\d(?:\.\d)?)", re.IGNORECASE)
_REQUEST_START = r"(?is)^\s*(GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+\S+\s+HTTP/\d(\.\d)?\s*(\n.*)?$"


def request_head(text: str) -> str:
    """A request with the shape of its target and the header fields that may stay; its body percent-decoded."""
    head, gap, body = text.partition("\n\n")
    lines = head.splitlines()
    if not lines or not (found := REQUEST.fullmatch(lines[0].strip())):
        return text
    out = [f"{found[1].upper()} {uri_shape(found[2])} {found[3].upper()}"]
    for name, colon, value in (line.partition(":") for line in lines[1:]):
        key = name.strip().casefold()
        if colon and key == "user-agent":
            out.append("User-Agent: <CLIENT>")
        elif colon and key in HEADERS:
            out.append(f"{name.strip()[:40]}: {HEADERS[key] or value.strip()[:120]}")
    return "\n".join(out) + ("\n\n" + CONTROL.sub(" ", unquote(body)) if gap and body.strip() else "")


def masked(text: Column, most: int = 768) -> Column:
    """A payload without identities, secrets, times, tools and values, of at most ``most`` characters.

    Null for a response, and for a text of which nothing is left. Requests and texts with character references go
    through Python first; all masks are Spark's, in which a file's ending keeps its case.
    """
    if not 64 <= most <= 2048:
        raise ValueError("64 to 2048 characters")
    unescaped = F.when(F.contains(text, F.lit("&")), _udf(html.unescape)(F.when(F.contains(text, F.lit("&")), text))).otherwise(text)
    plain = F.regexp_replace(F.regexp_replace(unescaped, r"\r\n?", "\n"), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    request = plain.rlike(_REQUEST_START)
    out = F.when(request, _udf(request_head)(F.when(request, plain))).otherwise(plain)
    for pattern, put in MASKS:
        out = F.regexp_replace(out, pattern, put)
    response = plain.rlike(r"(?i)^\s*HTTP/\d(\.\d)?\s+\d{3}\b")
    return F.when(~response & (out != ""), F.substring(out, 1, most))


#: What a log may not show.
SECRETS = [
    (r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    (r"(?i)\b(api[_-]?key|password|secret|access[_-]?token)\s*[:=]\s*[^\s,;]+", "$1=[REDACTED]"),
]
SECRET_KEY = r"(?i)(?:api[_-]?key|authorization|bearer|password|passwd|secret|access[_-]?token|private[_-]?key)"


def redacted(text: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A text without known secrets, the longest first, and without what looks like one."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def redacted_map(values: Column, secrets: tuple[str, ...] = ()) -> Column:
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), "[REDACTED]").otherwise(redacted(v, secrets)))


# --- JSON ----------------------------------------------------------------------------------------------------------------


def embedded(text: str) -> list[str]:
    """The JSON objects and arrays in a text, none within another."""
    reader, at, out = json.JSONDecoder(), 0, []
    while found := re.compile(r"[{\[]").search(text, at):
        try:
            value, at = reader.raw_decode(text, found.start())
            out.append(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
        except json.JSONDecodeError:
            at = found.start() + 1
    return out


def unfenced(text: Column) -> Column:
    """A model's answer without its thinking and the fence around it."""
    t = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    t = F.trim(F.regexp_replace(t, r"(?is)^.*</think>", ""), F.lit(" \n\t\r"))
    return F.trim(F.regexp_replace(t, r"(?is)^```(?:json)?\s*(.*?)\s*```$", "$1"), F.lit(" \n\t\r"))


def json_value(text: Column) -> Column:
    """The one JSON value of a model's answer, in canonical form; null if it has none or several."""
    t = unfenced(text)

    def one(x: str) -> str | None:
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except json.JSONDecodeError:
            found = embedded(x)
            return found[0] if len(found) == 1 else None

    return _udf(one)(t)


def tolerant_object(text: Column) -> Column:
    """The JSON object of a text: as it is, without its fence, or from the first brace to the last; null if none parses."""

    def one(x: str) -> str | None:
        spans = re.search(r"\{.*\}", x, re.DOTALL)
        for part in (x.strip(), re.sub(r"^```(?:json)?\s*|\s*```$", "", x.strip()).strip(), spans and spans[0]):
            try:
                if isinstance(value := json.loads(part or ""), dict):
                    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            except json.JSONDecodeError:
                pass
        return None

    return _udf(one)(text)


def compact(items: Column, fields: list[str]) -> Column:
    """An array of structs as JSON rows below one legend of field names."""
    rows = F.transform(items, lambda i: F.array(*[i[f].cast("string") for f in fields]))
    return F.to_json(F.struct(F.lit(",".join(fields)).alias("format"), rows.alias("items")))


def expanded(text: Column, fields: list[str]) -> Column:
    """The structs of ``compact``; null for another legend or a row of another width."""
    value = F.from_json(text, "format string, items array<array<string>>")
    fits = (value["format"] == ",".join(fields)) & F.forall(value["items"], lambda r: F.size(r) == len(fields))
    return F.when(fits, F.transform(value["items"], lambda r: F.struct(*[r[k].alias(f) for k, f in enumerate(fields)])))


# --- documents -----------------------------------------------------------------------------------------------------------

HIDDEN, BREAKS = ("script", "style", "svg", "nav", "footer"), ("p", "li", "h1", "h2", "h3", "pre")


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__()
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.depth += 1
        elif not self.depth and tag in (*BREAKS, "br"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.depth:
            self.depth -= 1
        elif not self.depth and tag in BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def visible(page: str) -> str:
    parser = _Visible()
    parser.feed(page)
    return " ".join(parser.out)


def visible_text(page: Column, kind: Column | None = None) -> Column:
    """What a page shows, with white space packed; a text that is no page is packed alone."""
    is_page = F.contains(F.lower(F.substring(page, 1, 1000)), F.lit("<html"))
    if kind is not None:
        is_page = is_page | F.contains(F.lower(kind), F.lit("html"))
    text = F.when(is_page, _udf(visible)(F.when(is_page, page))).otherwise(page)
    packed = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n\n")
    return F.regexp_replace(packed, r"^\s+|\s+$", "")


def front_matter(text: Column) -> Column:
    """``head`` (lines of ``key: value`` as a map), ``body`` of a Markdown document; null without front matter or body."""
    t = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")
    head, body = (F.regexp_extract(t, r"(?s)^---[ \t]*\n(.*?)\n?---[ \t]*(?:\n(.*))?$", k) for k in (1, 2))
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    side = lambda k: F.transform(pairs, lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):(.*)$", k)), r"^([\"'])(.*)\1$", "$2"))
    found = F.struct(F.map_from_arrays(side(1), side(2)).alias("head"), F.trim(body, F.lit(" \n\t")).alias("body"))
    return F.when(t.rlike(r"(?s)^---[ \t]*\n.*\n---[ \t]*\n.*\S"), found)


def units(body: str) -> list[str]:
    """Headings and paragraphs, in order: a heading is a unit of its own, a blank line ends a paragraph."""
    blocks: list[list[str]] = [[]]
    for line in body.splitlines():
        if line.startswith("#"):
            blocks += [[line], []]
        elif line.strip():
            blocks[-1].append(line.rstrip())
        else:
            blocks.append([])
    return [u for b in blocks if (u := "\n".join(b).strip())]


def pieces(unit: str, most: int) -> list[str]:
    """A unit in pieces of at most ``most`` characters, cut at white space; a longer word is a piece of its own."""
    if len(unit) <= most:
        return [unit]
    out = [""]
    for word in re.split(r"(\s+)", unit):
        if out[-1] and len(out[-1]) + len(word) > most:
            out.append("")
        out[-1] += word
    return [p.strip() for p in out[:-1]] + ([out[-1].strip()] if out[-1].strip() else [])


def chunks(body: str, most: int = 1600, target: int = 1000) -> list[str]:
    """Units packed in order to chunks that close at ``target`` characters and have at most ``most``; a short tail joins the last."""
    done, held = [], []
    size = lambda parts: sum(map(len, parts)) + 2 * (len(parts) - 1)
    for piece in (p for u in units(body) for p in pieces(u, most)):
        if held and size([*held, piece]) > most:
            done.append(held)
            held = []
        held = [*held, piece]
        if size(held) >= target:
            done.append(held)
            held = []
    texts = ["\n\n".join(d).strip() for d in done]
    if held:
        tail = "\n\n".join(held).strip()
        if texts and len(texts[-1]) + 2 + len(tail) <= most:
            texts[-1] += "\n\n" + tail
        else:
            texts.append(tail)
    return texts


def document_chunks(body: Column, most: int = 1600, target: int = 1000) -> Column:
    if not 200 <= most or not 100 <= target <= most:
        raise ValueError("most is 200 at least, target 100 to most")

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else chunks(x, most, target))

    return run(body)
