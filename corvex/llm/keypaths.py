"""Configuration formats as key paths with the offsets of their values: JSON, YAML, TOML, INI, properties, env and XML.

The readers take what people really write: repeated keys, lines that fit no grammar and ends that are missing cost the
entry they stand in, not the file. They work on a text in which one character stands for one byte (bytes decoded as
Latin-1), so offsets are byte offsets. A path holds the last few keys, outermost first; where a record pairs a name with
a value (``name: X, value: y``, ``<add key="X" value="y"/>``), the name ends the path of that value once more.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

DEPTH = 4  # keys of a path that are kept: what a judgement looks at


class Entry(NamedTuple):
    path: tuple[str, ...]
    start: int
    end: int
    quoted: bool
    key: tuple[int, int] | None  # where the value's own key stands


#: Keys under which records write the name and the value of a setting.
NAMES = {"name", "key", "id", "variable", "var", "env", "param", "parameter", "property", "setting", "field", "include"}
VALUES = {"value", "val", "default", "defaultvalue", "data", "content", "contents", "text", "plaintext", "plain", "literal", "string", "raw", "stringvalue", "valuestring", "secretstring", "currentvalue"}

_NAME = re.compile(r"[A-Za-z_][\w.:/-]{0,200}", re.A)


def plain_key(key: str) -> str:
    return re.sub(r"[^a-z]", "", key.lower())


class _Record:
    """The names and values of one record, paired when it ends."""

    __slots__ = ("name", "values")

    def __init__(self) -> None:
        self.name: str | None = None
        self.values: list[Entry] = []

    def add(self, key: str, entry: Entry, text: str) -> None:
        plain = plain_key(key)
        if plain in VALUES:
            self.values.append(entry)
        elif plain in NAMES and self.name is None and _NAME.fullmatch(text, entry.start, entry.end):
            self.name = text[entry.start : entry.end]

    def pairs(self) -> Iterator[Entry]:
        if self.name:
            for e in self.values:
                yield e._replace(path=(*e.path[:-1], self.name)[-DEPTH:])


# JSON and the flow collections of YAML and TOML.

_STRINGS = r"\"(?:[^\"\\\r\n]++|\\[^\r\n])*+\"|'(?:[^'\\\r\n]++|\\[^\r\n])*+'"
_SKIP = r"[\s,]++|//[^\r\n]*+|(?<!\S)\#[^\r\n]*+"
_JSON = re.compile(rf"(?P<skip>{_SKIP})|(?P<s>{_STRINGS})|(?P<p>[{{}}\[\]:=])|(?P<w>[^\s\"'{{}}\[\]:,=]++)|(?P<x>.)", re.S | re.A)
_FLOW = re.compile(rf"(?P<skip>{_SKIP})|(?P<s>{_STRINGS})|(?P<p>[{{}}\[\]=]|:(?=[\s,\"'\[\]{{}}]|$))|(?P<w>(?:[^\s\"'{{}}\[\]:,=]|:(?![\s,\[\]{{}}]|$))++)|(?P<x>.)", re.S | re.A)


def flow(text: str, at: int = 0, end: int | None = None, base: tuple[str, ...] = (), tokens: re.Pattern = _FLOW) -> Iterator[Entry | int]:
    """Entries of one bracketed value that begins at ``at``; last comes where it ends, as a number."""
    end = len(text) if end is None else end
    # A frame: is it an object, its path, the key in force and where it stands, its record.
    frames: list[list] = []
    pending: tuple[str, int, int] | None = None
    while at < end:
        m = tokens.match(text, at, end)
        at = m.end()
        kind = m.lastgroup
        if kind == "skip":
            if frames and frames[-1][0] and "," in m[0]:
                frames[-1][2] = pending = None
        elif kind == "p":
            c = m[0]
            if c in "{[":
                path = base if not frames else (*frames[-1][1], frames[-1][2][0])[-DEPTH:] if frames[-1][2] else frames[-1][1]
                frames.append([c == "{", path, None, _Record()])
                pending = None
            elif c in "}]":
                if frames:
                    yield from frames.pop()[3].pairs()
                if not frames:
                    break
                pending = None
            elif frames and frames[-1][0] and pending:
                frames[-1][2], pending = pending, None
        elif kind in ("s", "w") and frames:
            start, stop = (m.start() + 1, at - 1) if kind == "s" else m.span()
            frame = frames[-1]
            if frame[0] and frame[2] is None:
                pending = (text[start:stop], start, stop)
            else:
                key = frame[2]
                path = (*frame[1], key[0])[-DEPTH:] if key else frame[1]
                if path:
                    entry = Entry(path, start, stop, kind == "s", key[1:] if key else None)
                    yield entry
                    if key:
                        frame[3].add(key[0], entry, text)
        elif not frames:
            break
    for frame in reversed(frames):
        yield from frame[3].pairs()
    yield at


def json_entries(text: str) -> Iterator[Entry]:
    at = re.compile(r"(?:\xef\xbb\xbf)?(?:\s++|//[^\r\n]*+|/\*.*?\*/)*+", re.S | re.A).match(text).end()
    # Several values one after the other are as good as one.
    while at < len(text):
        for x in flow(text, at, tokens=_JSON):
            if isinstance(x, int):
                at = max(x, at + 1)
            else:
                yield x


# Formats of lines.

_LINE = re.compile(r"([^\r\n]*)(\r\n|\n|\r|$)", re.A)


def _lines(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(text):
        m = _LINE.match(text, at)
        yield m.span(1)
        at = m.end()


def _closed(text: str, at: int, end: int) -> int | None:
    """Where the quoted value that begins at ``at`` is closed on its line, if it is."""
    m = re.compile(_STRINGS, re.A).match(text, at, end)
    return m.end() if m else None


def _bare_end(text: str, at: int, end: int, comment: str) -> int:
    m = re.compile(rf"\s+[{comment}]", re.A).search(text, at, end)
    end = m.start() if m else end
    while end > at and text[end - 1] in " \t":
        end -= 1
    return end


_YAML = re.compile(r"(?P<indent>[ \t]*+)(?P<dashes>(?:-[ \t]+)*+)", re.A)
_YAML_KEY = re.compile(rf"""(?P<k>{_STRINGS}|[^\s\#"'\[\]{{}}&*!|>%@`,:][^:\#\r\n]*?(?::[^\s:\#][^:\#\r\n]*?)*?)[ \t]*:(?=[ \t]|$)[ \t]*""", re.A)
_ANCHOR = re.compile(r"(?:&[^\s]+[ \t]+|!!\w+[ \t]+)*", re.A)


def yaml_entries(text: str) -> Iterator[Entry]:
    """Block mappings by indentation; a line that is no part of a mapping and no value is passed over."""
    stack: list[list] = []  # indent, path above, key, record
    skip_to, block = 0, None  # the end of a flow collection; a block scalar: path, key, indent, first, last

    def path_above(indent: int) -> tuple[str, ...]:
        return (*stack[-1][1], stack[-1][2][0])[-DEPTH:] if stack and stack[-1][0] < indent else ()

    for begin, end in _lines(text):
        if end <= skip_to or begin < skip_to:
            continue
        m = _YAML.match(text, begin, end)
        indent, at = len(m["indent"]), m.end()
        if block:
            if at >= end and not m["dashes"]:
                continue
            if indent > block[2]:
                block[3:] = [block[3] if block[3] >= 0 else begin + indent, _bare_end(text, begin + indent, end, "\0")]
                continue
            yield from _block(block, text)
            block = None
        if at >= end or text[at] == "#" or text.startswith("---", begin) or text.startswith("%", begin):
            if text.startswith("---", begin) and indent == 0:
                while stack:
                    yield from stack.pop()[3].pairs()
            continue
        column = at - begin
        while stack and stack[-1][0] > (indent if m["dashes"] else column):
            yield from stack.pop()[3].pairs()
        k = _YAML_KEY.match(text, at, end)
        if not k:
            # A scalar on a line of its own belongs to the key above it.
            if stack and stack[-1][0] < column or m["dashes"] and stack:
                yield from _yaml_value(text, at, end, (*stack[-1][1], stack[-1][2][0])[-DEPTH:], stack[-1][2][1:])
            continue
        name = k["k"].strip("\"'")
        key = (name, *k.span("k"))
        if stack and stack[-1][0] == column:
            stack[-1][2] = key
        else:
            stack.append([column, path_above(column), key, _Record()])
        path = (*stack[-1][1], name)[-DEPTH:]
        at = _ANCHOR.match(text, k.end(), end).end()
        if at >= end or text[at] == "#":
            continue
        if text[at] in "|>":
            block = [path, key, column, -1, -1]
            continue
        if text[at] in "{[":
            for x in flow(text, at, base=path):
                if isinstance(x, int):
                    skip_to = x
                else:
                    yield x
            continue
        for e in _yaml_value(text, at, end, path, key[1:]):
            yield e
            stack[-1][3].add(name, e, text)
    if block:
        yield from _block(block, text)
    while stack:
        yield from stack.pop()[3].pairs()


def _block(block: list, text: str) -> Iterator[Entry]:
    path, key, _, first, last = block
    if 0 <= first < last:
        yield Entry(path, first, last, True, key[1:])


def _yaml_value(text: str, at: int, end: int, path: tuple[str, ...], key: tuple[int, int]) -> Iterator[Entry]:
    if text[at] in "\"'" and (stop := _closed(text, at, end)):
        yield Entry(path, at + 1, stop - 1, True, key)
    elif text[at] not in "\"'*!{[&|>":  # aliases and tags of references are no values
        yield Entry(path, at, _bare_end(text, at, end, "#"), False, key)


_SECTION = re.compile(r"[ \t]*\[{1,2}[ \t]*([^\]\r\n]+?)[ \t]*\]{1,2}[ \t]*(?:[#;].*)?", re.A)
_PAIR = re.compile(rf"""[ \t]*(?:(?:export|set|setenv)[ \t]+)?(?P<k>{_STRINGS}|[\w$][\w.$/@-]*+(?:[ ][\w.-]++){{0,3}}?)[ \t]*(?:=|:(?![:/=]))[ \t]*""", re.A)
_TRIPLE = re.compile(r'"""(.*?)"""|' + r"'''(.*?)'''", re.S)


def section_entries(text: str) -> Iterator[Entry]:
    """TOML, INI, properties and env files: sections of ``key = value``."""
    section: tuple[str, ...] = ()
    record, skip_to, waiting = _Record(), 0, None
    for begin, end in _lines(text):
        if begin < skip_to:
            continue
        first = begin
        while first < end and text[first] in " \t":
            first += 1
        if first >= end or text[first] in "#;!" or text.startswith("//", first):
            continue
        if m := _SECTION.fullmatch(text, begin, end):
            yield from record.pairs()
            section, record, waiting = tuple(x.strip(" \"'") for x in m[1].split("."))[-DEPTH + 1 :], _Record(), None
            continue
        m = _PAIR.match(text, begin, end)
        if not m:
            if waiting and first > begin:
                yield Entry(*waiting[:1], first, _bare_end(text, first, end, "#;"), False, waiting[1])
            waiting = None
            continue
        name, at = m["k"].strip("\"'"), m.end()
        path, key = (*section, *name.split("."))[-DEPTH:], m.span("k")
        waiting = (path, key) if at >= end else None
        if at >= end:
            continue
        if t := _TRIPLE.match(text, at):
            group = 1 if t[1] is not None else 2
            skip_to, entry = t.end(), Entry(path, *t.span(group), True, key)
            entry = entry._replace(start=entry.start + len(t[group]) - len(t[group].lstrip("\r\n")), end=entry.end - len(t[group]) + len(t[group].rstrip("\r\n \t")))
        elif text[at] in "\"'" and (stop := _closed(text, at, end)):
            entry = Entry(path, at + 1, stop - 1, True, key)
        elif text[at] in "{[":
            for x in flow(text, at, base=path):
                if isinstance(x, int):
                    skip_to = x
                else:
                    yield x
            continue
        else:
            entry = Entry(path, at, _bare_end(text, at, end, "#;"), False, key)
        yield entry
        record.add(name, entry, text)
    yield from record.pairs()


# XML.

_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>]*>|</(?P<close>[^\s>]+)\s*>|<(?P<open>[A-Za-z_][\w.:-]*)(?P<attrs>(?:[^<>\"'/]++|/(?!>)|\"[^\"<]*+\"|'[^'<]*+')*+)(?P<empty>/?)>|(?P<text>[^<]+)", re.S | re.A)
_ATTRIBUTE = re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"<]*)\"|'([^'<]*)')", re.A)


def xml_entries(text: str) -> Iterator[Entry]:
    """Elements' texts and attributes; the path of an element that has a name of its own goes by that name too."""
    stack: list[tuple[str, str | None]] = []
    named: list[str | None] = [None]  # of each level, the text of the last <key> or <name>
    at = 0
    while at < len(text):
        m = _MARKUP.match(text, at)
        if not m:
            at += 1
            continue
        at = m.end()
        if m["open"]:
            element, found = m["open"].rpartition(":")[2], list(_ATTRIBUTE.finditer(text, *m.span("attrs")))
            record = _Record()
            above = tuple(x for e, n in stack[-DEPTH:] for x in (e, n) if x)
            for a in found:
                group = 2 if a[2] is not None else 3
                e = Entry((*above, element, a[1])[-DEPTH:], *a.span(group), True, a.span(1))
                yield e
                record.add(a[1], e, text)
            yield from record.pairs()
            if not m["empty"]:
                stack.append((element, record.name))
                named.append(None)
        elif m["close"]:
            # An end that closes an outer element closes what lies within.
            name = m["close"].rpartition(":")[2]
            for i in range(len(stack) - 1, max(-1, len(stack) - 64), -1):
                if stack[i][0] == name:
                    del stack[i:], named[i + 1 :]
                    break
        elif stack and (m["text"] is not None or m["cdata"] is not None):
            group = "text" if m["text"] is not None else "cdata"
            body = m[group]
            start = m.start(group) + len(body) - len(body.lstrip())
            stop = m.end(group) - len(body) + len(body.rstrip())
            if start < stop:
                element, name = stack[-1]
                above = tuple(x for e, n in stack[-DEPTH:] for x in (e, n) if x)
                yield Entry(above[-DEPTH:], start, stop, True, None)
                plain, level = plain_key(element), len(stack) - 1
                if plain in NAMES and _NAME.fullmatch(text, start, stop):
                    named[level] = text[start:stop]
                elif named[level]:
                    yield Entry((*above[:-1], named[level])[-DEPTH:], start, stop, True, None)
                    if plain not in VALUES or plain == "string":
                        named[level] = None


# Which format a text has.

#: Extensions and names of files by format.
_BY_EXTENSION = {
    **dict.fromkeys(("json", "jsonc", "json5", "map", "ipynb", "tfstate", "webmanifest", "tfvars.json", "har", "arb"), "json"),
    **dict.fromkeys(("yaml", "yml", "eyaml"), "yaml"),
    **dict.fromkeys(("toml", "ini", "cfg", "conf", "cnf", "properties", "env", "dotenv", "tfvars", "npmrc", "pypirc", "gitconfig", "prefs", "editorconfig"), "section"),
    **dict.fromkeys(("xml", "config", "csproj", "plist", "resx", "props", "targets", "settings", "nuspec", "pom", "wsdl", "xaml"), "xml"),
}
_READERS: dict[str, Callable[[str], Iterator[Entry]]] = {"json": json_entries, "yaml": yaml_entries, "section": section_entries, "xml": xml_entries}
_FIRST = re.compile(r"(?:\xef\xbb\xbf)?(?:\s++|//[^\r\n]*+|/\*.*?\*/)*+(?P<c>\{\s*+(?:[\"'}]|[A-Za-z_$][\w$-]*\s*:)|\[\s*+[\"{\[\]\d]|<(?:\?xml|!--|!DOCTYPE|[A-Za-z_][\w.:-]*(?:\s+[\w.:-]+\s*=|\s*/?>)))", re.S | re.A)
_YAML_LIKE = re.compile(rf"[ \t]*(?:-[ \t]+)*(?:(?:{_STRINGS}|[A-Za-z_][\w./ -]*):(?:[ \t]+[^\s;].*|[ \t]*)|-[ \t]+\S.*|\#.*|---.*)", re.A)
_SECTION_LIKE = re.compile(rf"[ \t]*(?:(?:(?:export|set)[ \t]+)?(?:{_STRINGS}|[\w$][\w.$/@-]*)[ \t]*=(?!=).*|\[{{1,2}}[^\]]+\]{{1,2}}|[#;].*)", re.A)
_CODE_LIKE = re.compile(r".*[;{(]\s*|\s*[)}\]]+[;,]?\s*|\s*(?:def|class|import|from|return|if|for|while|func|fn|let|const|var|package|use|public|private)\b.*", re.A)


def _share(text: str, like: re.Pattern) -> float:
    fits = n = 0
    for begin, end in _lines(text):
        if text[begin:end].strip():
            n += 1
            fits += like.fullmatch(text, begin, end) is not None
    return fits / n if n else 0.0


def format_of(text: str, path: str | None) -> tuple[str | None, bool]:
    """The format of a text, by its name and by what it holds, as names lie; and whether its values are surely literals
    (a file named as configuration), not expressions."""
    name = (path or "").rpartition("/")[2].lower()
    extension = name.rpartition(".")[2] if "." in name else ""
    if name.startswith(".env"):
        extension = "env"
    said = _BY_EXTENSION.get(extension)
    first = _FIRST.match(text)
    c = first["c"][0] if first else ""
    if said == "json" and c in ("{", "[") or said == "xml" and c == "<":
        return said, True
    if said == "section" and c == "<":
        return "xml", True
    if said == "yaml" and c == "{":
        return "json", True
    if said in ("yaml", "section"):
        fits = _share(text, _YAML_LIKE if said == "yaml" else _SECTION_LIKE)
        return (said, True) if fits >= 0.5 and _share(text, _CODE_LIKE) < 0.5 else (None, False)
    if extension and path is not None:
        return None, False
    if c == "<":
        return "xml", False
    if c in ("{", "["):
        return "json", False
    if _share(text, _CODE_LIKE) < 0.2:
        if _share(text, _YAML_LIKE) >= 0.7:
            return "yaml", False
        if _share(text, _SECTION_LIKE) >= 0.8:
            return "section", False
    return None, False


def entries(text: str, path: str | None = None) -> tuple[list[Entry], bool]:
    """All entries of a configuration text (none of any other), and whether their values are surely literals."""
    kind, literal = format_of(text, path)
    return (list(_READERS[kind](text)), literal) if kind else ([], False)
