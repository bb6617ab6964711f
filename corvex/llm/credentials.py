"""Credentials written out in source code and configuration, and the same bytes with only them masked.

Configuration formats are parsed into key paths with the byte offsets of their values (``keypaths``); a value is a
finding if its path names a credential and it has the shape of one. Source code, prose and comments are read line by
line as the assignments of string literals they may hold. Values with a shape of their own (tokens with a known prefix,
header values, URLs and connection strings with a password, private key blocks) are found under any key. Redactions are
spliced into the original bytes at the offsets.

All patterns run over the text's UTF-8 bytes, one character for each byte.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.llm import keypaths

# Words by which keys are judged, after splitting at case changes and signs.
_PASS = {"password", "passwd", "passphrase", "pwd", "pass", "pw", "passcode"}
_KEY_OF = {"api", "access", "secret", "private", "deploy", "signing", "encryption", "auth", "account", "service", "master", "license", "storage", "shared", "app", "subscription", "sign", "crypto", "hmac", "jwt", "admin"}
_TOKEN_OF = {"access", "auth", "api", "host", "bearer", "refresh", "session", "bot", "deploy", "id", "user", "app", "private", "personal", "security", "secret", "git", "github", "gitlab", "gitea", "bitbucket", "slack", "npm", "pypi", "oauth", "csrf", "webhook", "ci", "job", "registry", "service", "admin", "client", "x", "vault", "push", "my", "the", "account"}
_JOINED = re.compile(r"(?:password|passwd|passphrase|(?:api|access|secret|private|deploy|signing|encryption|auth)key|(?:access|auth|api|host|bearer|refresh|deploy|session)token|(?:client|webhook|app|api|shared|consumer|jwt|hmac)secret|accesskeyid|secretaccesskey)$")
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
_PLACEHOLDER = re.compile(
    r"""(?ixa) change.?me.* | to.?do | fix.?me | tbd | x+ | \*+ | \.+ | -+ | \#+ | _+ | 0+ | password | passwd | secret | none | null | nil | undefined | true | false | dummy.* | fake.* | sample.* | test | example.* | .*[-_.]example | placeholder.* | redacted.* | masked
    | your.* | my[-_ ]?(?:password|secret|token|key).* | .*[-_ ]here | (?:replace|insert|enter|put|set|add|fill)[-_ ]?.* | (?:pass|password|token|secret|api.?key)[-_]?(?:goes)?[-_]?(?:value|here)?
    | <.*> | \[.*\] | \$\{?[A-Z_][A-Z0-9_]*\}? | \$\{.*\} | \$\(.*\) | %\(.*\)s | %[A-Z_]+% | %s | \{.*\} | @.*@ | \#\{.*\}
    | (?:env|vault|ssm|secret|secrets|keyring|file|ref|sops|op|arn|gcp|aws|azure|kms|config)[:/].* | (?:os|process|System|ENV|env|config|settings|secrets|vault|self|this|args|opts|options|params|request|req|ctx|viper|getenv)\b[.\[(].*"""
)

_STRING = r"""(?:[bBrRuUfF@$]{0,2})(?P<q>\"\"\"|'''|["'`])(?P<v>[^\r\n]*?)(?<!\\)(?P=q)"""
# Only what wraps a literal; os.Getenv("NAME") and the like are references.
_WRAP = r"(?:(?:new\s+)?(?:[\w.:]*(?:[Ss]tring|SecretStr|Secret|[Bb]ytes|Buffer\.from|Some|String::from)|str|S|Text|literal)\(\s*)?"
_TYPE = r"(?:\s*:\s*&?\s*(?:'static\s+)?(?:mut\s+)?[A-Za-z_][\w:<>?\[\]]*(?=\s*=))?"
_ASSIGNED = re.compile(rf"""(?P<k>[A-Za-z_$][\w$-]*)["'`]?\]?{_TYPE}\s*(?:=>|:=|\?\?=|=(?!=)|:(?!:))\s*{_WRAP}{_STRING}""", re.A)
_LISTED = re.compile(rf"""["'`:](?P<k>[A-Za-z_$][\w$.-]*)["'`]?\s*,\s*{_WRAP}{_STRING}""", re.A)
_SPACED = re.compile(rf"""(?:\#\s*define\s+(?P<k>\w+)|\b(?P<sql>PASSWORD|IDENTIFIED\s+BY|password|identified\s+by))\s+{_STRING}""", re.A)
_FLAG = re.compile(r"""(?<![\w-])--?(?P<k>[A-Za-z][\w-]*)(?:=|\s+)(?P<v>[^\s"'`;|&<>]+)""", re.A)
_HEADER = re.compile(r"""(?<![\w-])(?P<k>[A-Za-z][A-Za-z]*(?:-[A-Za-z]+)+):\s*(?P<v>[^\s"'`;|&<>,:]+)""", re.A)
_BARE = re.compile(r"""(?:^|[`({,])[ \t]*(?:export\s+|set\s+|-\s+|[#/;*-]+[ \t]+)?(?:[A-Za-z_][\w-]*\.)*(?P<k>[A-Za-z_][\w-]*)[ \t]*[:=][ \t]*(?P<v>[^\s"'`,]+)[ \t]*(?=$|`|\s[#;])""", re.A)

_PREFIXED = re.compile(
    r"""(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16} | gh[pousr]_[A-Za-z0-9]{36,} | github_pat_\w{22,} | glpat-[\w-]{20,} | xox[abeprs]-[A-Za-z0-9-]{10,} | sk-[A-Za-z0-9_-]{20,}
    | [a-z]{2,6}_(?:live|test|prod)_[A-Za-z0-9]{16,} | AIza[\w-]{35} | npm_[A-Za-z0-9]{36} | SG\.[\w-]{16,}\.[\w-]{16,} | hf_[A-Za-z]{30,})(?![A-Za-z0-9_/+=-])""",
    re.X | re.A,
)
_AUTHORIZATION = re.compile(r"""(?ia)authorization["'`]?\]?\s*[:=,]\s*["'`]?\s*(?:bearer|basic|token|digest)\s+(?P<v>[^\s"'`\\,;<>]+)""")
_BEARER = re.compile(r"""\b[Bb]earer\s+(?P<v>[A-Za-z0-9_~+/.-]{16,}=*)""", re.A)
_URL = re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@"'`<>?#]*:(?P<v>[^\s/@"'`<>]+)@[^\s@"'`]""", re.A)
_CONNECTION = re.compile(r"""(?ia)(?:;|["'`=:\s])\s*(?:password|pwd)\s*=\s*(?P<v>[^;"'`\s]+)(?=;|["'`]|\s|$)""")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_IN_CONNECTION = re.compile(r"(?ia)(?:server|host|data source|uid|user id|user|database|initial catalog|pool|port)\s*=[^;]*;")

#: Every key that names a credential holds one of these, as each rule of key_kind ends in one.
KEY_HINTS = ("pass", "pw", "secret", "key", "credential", "auth", "token")
#: Of these a line with a finding holds at least one, in lower case; only such lines are looked into.
HINTS = (
    *(h for h in KEY_HINTS if h != "token"),
    *("bearer", "identified", "akia", "asia", "gho_", "ghp_", "ghu_", "ghs_", "ghr_", "github_pat", "glpat-", "xox", "sk-", "_live_", "_test_", "_prod_", "aiza", "npm_", "sg.", "hf_"),
)


def _hint_places(low: str) -> Iterator[int]:
    for h in HINTS:
        at = low.find(h)
        while at >= 0:
            yield at
            at = low.find(h, at + len(h))
    at = low.find("token")
    while at >= 0:
        if low[at + 5 : at + 7] != "iz":
            yield at
        at = low.find("token", at + 5)
    at = low.find("://")
    while at >= 0:
        end = low.find("@", at)
        if end < 0:
            break
        if not any(c in low[at + 3 : end] for c in " /\n"):
            yield at
        at = low.find("://", at + 3)


def key_kind(key: str) -> str | None:
    """``sure`` if the key names a credential, ``maybe`` if only a value of random shape makes it one, else None."""
    words = [w.lower() for w in _SPLIT.findall(key) if not w.isdigit()]
    if not words:
        return None
    last, before = words[-1], words[-2] if len(words) > 1 else None
    if last in _PASS:
        return "sure" if last != "pass" or before in {"db", "user", "smtp", "root", "admin", "mail", "ftp", "redis", "mysql", "my", None} else "maybe"
    if last in ("secret", "secrets"):
        return "sure"
    if last == "key" and before in _KEY_OF or words[-3:] == ["access", "key", "id"] or last == "token" and (before is None or before in _TOKEN_OF):
        return "sure"
    if _JOINED.search("".join(words)) and len(words) <= 2 and any(h in key.lower() for h in KEY_HINTS):
        return "sure"
    return "maybe" if last in ("token", "key", "credential", "credentials", "auth") and before is not None else None


_CHANGE = re.compile(r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])", re.A)


def scrambled(value: str) -> bool:
    """Long, and changing between lower case, upper case and digits far more often than names do."""
    return len(value) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", value) is not None and 4 * len(_CHANGE.findall(value)) >= len(value)


def random_shape(value: str) -> bool:
    """Long, without the structure of words: letters of both cases, with digits."""
    if len(value) < 16 or not re.fullmatch(r"[A-Za-z0-9+/_=-]+", value) or not re.search(r"\d", value):
        return False
    return scrambled(value) or bool(re.search(r"[a-z]", value) and re.search(r"[A-Z]", value)) and not re.search(r"[a-z]{9}", value)


# What a value in a configuration file may be besides a literal: a word or number, a call, a path or a reference.
_NO_LITERAL = re.compile(
    r"""(?xa) [A-Za-z_]+(?:[.:/-][A-Za-z_]+)*[;,]? | \d{1,8} | [\w.:]+\(.*\)[;,]? | [&*!\[{<(|>].*"""
)
_FILE = re.compile(r"(?:~|\.{1,2})/.*|/(?:etc|var|run|home|usr|opt|tmp|mnt|secrets?)/.*|[\w./\\-]+\.(?:pem|key|crt|cer|p12|pfx|jks|json|txt|ya?ml|env|conf|pub)", re.A)


def _credential(kind: str | None, value: str, quoted: bool | None) -> bool:
    """``quoted`` is None for a value without quotes that is surely a literal."""
    if kind is None or not 4 <= len(value) or "-----BEGIN" in value or re.search(r"\s", value, re.A) or _PLACEHOLDER.fullmatch(value) or _FILE.fullmatch(value):
        return False
    if "://" in value or _IN_CONNECTION.search(value):
        return False  # its password, if any, is found as such
    if kind == "maybe":
        return random_shape(value)
    if quoted is None:
        # Names joined by hyphens are no expression where values are literals, and common as passwords if they hold a digit.
        return not _NO_LITERAL.fullmatch(value)
    # Unquoted, it may be an expression: a credential has no brackets, and is no plain word, name or number.
    return quoted or not re.search(r"[()\[\]{}<>]|^[&*]", value) and not re.fullmatch(r"[A-Za-z_]+(?:\.[A-Za-z_]\w*)*[;,]?|\d{1,8}[;,]?|[a-z_]+[A-Z]\w*;?|\w*_\w*(?:[.;]\w*)*", value, re.A) or scrambled(value)


def path_kind(path: tuple[str, ...]) -> tuple[str | None, bool]:
    """As ``key_kind`` for a key path, and whether the last key alone says so. A key that only says that a value follows
    leaves the judgement to the one above it; ``auth: {key: ...}`` is judged as ``auth_key``."""
    own = key_kind(path[-1])
    if own:
        return own, True
    for i in range(len(path) - 1, 0, -1):
        if keypaths.plain_key(path[i]) not in keypaths.VALUES:
            return key_kind(f"{path[i - 1]}_{path[i]}"), False
        if above := key_kind(path[i - 1]) or ("sure" if keypaths.plain_key(path[i - 1]) in ("credential", "credentials") else None):
            return above, False
    return None, False


def config_findings(text: str, path: str | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]], set[int]]:
    """Of a configuration text the spans of its credentials, those of its keys in order, and where its values begin."""
    found, keys, starts = [], set(), set()
    entries, literal = keypaths.entries(text, path)
    for e in entries:
        starts.add(e.start)
        if e.key:
            keys.add(e.key)
        kind, own = path_kind(e.path)
        if kind and _credential(kind, text[e.start : e.end], True if e.quoted and own else None if literal or e.quoted else False):
            found.append((e.start, e.end))
    return found, sorted(keys), starts


def _shaped_findings(line: str) -> Iterator[tuple[int, int]]:
    """Values with a shape of their own."""
    for m in _AUTHORIZATION.finditer(line):
        if not _PLACEHOLDER.fullmatch(m["v"]):
            yield m.span("v")
    for m in _BEARER.finditer(line):
        if re.search(r"\d", m["v"]) and not _PLACEHOLDER.fullmatch(m["v"]):
            yield m.span("v")
    for m in _PREFIXED.finditer(line):
        yield m.span()
    if "://" in line:
        for m in _URL.finditer(line):
            if not _PLACEHOLDER.fullmatch(m["v"]):
                yield m.span("v")
    if ";" in line and _IN_CONNECTION.search(line):
        for m in _CONNECTION.finditer(line):
            if not _PLACEHOLDER.fullmatch(m["v"]):
                yield m.span("v")


def _assigned_findings(line: str) -> Iterator[tuple[int, int]]:
    """Values that are credentials by the name they are assigned to."""
    for pattern, quoted in ((_ASSIGNED, True), (_LISTED, True), (_SPACED, True), (_FLAG, False), (_HEADER, False), (_BARE, False)):
        at = 0
        while m := pattern.search(line, at):
            at = max(m.start() + 1, m.end("k") if m.start("k") >= 0 else m.end())
            kind = "sure" if m.groupdict().get("sql") else key_kind(m["k"])
            if _credential(kind, m["v"], quoted):
                yield m.span("v")


#: What stands before a value, for each pattern: in long lines the pattern itself is tried from there over the whole line.
_HEADS = (
    (re.compile(rf"""(?P<k>[A-Za-z_$][\w$-]*)["'`]?\]?{_TYPE}\s*(?:=>|:=|\?\?=|=(?!=)|:(?!:))""", re.A), _ASSIGNED, True),
    (re.compile(r"""["'`:](?P<k>[A-Za-z_$][\w$.-]*)["'`]?\s*,""", re.A), _LISTED, True),
    (re.compile(r"""(?:\#\s*define\s+(?P<k>\w+)|\b(?P<sql>PASSWORD|IDENTIFIED\s+BY|password|identified\s+by))\s""", re.A), _SPACED, True),
    (re.compile(r"""(?<![\w-])--?(?P<k>[A-Za-z][\w-]*)[=\s]""", re.A), _FLAG, False),
    (re.compile(r"""(?<![\w-])(?P<k>[A-Za-z][A-Za-z]*(?:-[A-Za-z]+)+):""", re.A), _HEADER, False),
    (re.compile(r"""(?:^|[`({,])[ \t]*(?:export\s+|set\s+|-\s+|[#/;*-]+[ \t]+)?(?:[A-Za-z_][\w-]*\.)*(?P<k>[A-Za-z_][\w-]*)[ \t]*[:=]""", re.A), _BARE, False),
    (re.compile(r"(?i)authorization"), _AUTHORIZATION, None),
    (re.compile(r"\b[Bb]earer\s", re.A), _BEARER, None),
    (re.compile(r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk-|[a-z]{2,6}_(?:live|test|prod)_|AIza|npm_|SG\.|hf_)"), _PREFIXED, None),
    (re.compile(r"""\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@"'`<>?#]*:""", re.A), _URL, None),
    (re.compile(r"""(?ia)(?:;|["'`=:\s])\s*(?:password|pwd)\s*="""), _CONNECTION, None),
)


def _long_findings(line: str, start: int, end: int) -> Iterator[tuple[int, int, bool]]:
    """Findings that begin in a part of a long line, however far their values go on, and whether they rest on a name."""
    for head, pattern, quoted in _HEADS:
        at = start
        while h := head.search(line, at, end):
            at = h.start() + 1
            names = h.groupdict()
            kind = "sure" if names.get("sql") else key_kind(names["k"]) if names.get("k") else None
            if quoted is not None and kind is None or not (m := pattern.match(line, h.start())):
                continue
            if quoted is not None:
                good = _credential(kind, m["v"], quoted)
            elif pattern is _CONNECTION:
                good = not _PLACEHOLDER.fullmatch(m["v"]) and _IN_CONNECTION.search(line, max(0, m.start() - 400), m.end() + 400)
            else:
                good = pattern is _PREFIXED or not _PLACEHOLDER.fullmatch(m["v"]) and (pattern is not _BEARER or re.search(r"\d", m["v"]))
            if good:
                yield *(m.span("v") if "v" in pattern.groupindex else m.span()), quoted is not None


def _pieces(line: str, most: int = 4000, overlap: int = 1000) -> Iterator[tuple[int, str]]:
    """A line as it is, or a very long one in overlapping windows, so that the work stays linear."""
    if len(line) <= most:
        yield 0, line
        return
    for at in range(0, max(1, len(line) - overlap), most - overlap):
        yield at, line[at : at + most]


def find_spans(text: str, path: str | None = None) -> list[tuple[int, int]]:
    """Spans of the credentials of a text given as its bytes, one character for each, in order, without overlap; of
    overlapping ones the first, and of those the longest, counts. ``path`` tells the format; what the text holds decides."""
    low = text.lower()
    places = sorted(_hint_places(low))
    spans = [m.span() for m in _PRIVATE.finditer(text)] if "private key" in low else []
    found, keys, starts = config_findings(text, path) if places else ([], [], set())
    spans += found
    begins = [a for a, _ in keys]

    def judged(a: int) -> bool:
        """A place that its format has already told to be a key or a whole value is no assignment's value."""
        i = bisect_right(begins, a) - 1
        return a in starts or i >= 0 and a < keys[i][1]

    seen = -1
    for at in places:
        if at < seen:
            continue
        start = text.rfind("\n", 0, at) + 1
        start = max(start, text.rfind("\r", start, at) + 1)
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        cut = text.find("\r", at, end)
        end = seen = end if cut < 0 else cut
        line = text[start:end]
        for piece_start, piece in _pieces(line):
            whole, off = piece_start + len(piece) == len(line), start + piece_start
            # A value that a window cuts is found from where it begins.
            spans += [(off + a, off + b) for a, b in _shaped_findings(piece) if whole or b < len(piece)]
            spans += [(off + a, off + b) for a, b in _assigned_findings(piece) if (whole or b < len(piece)) and not judged(off + a)]
            if len(piece) < len(line):
                spans += [(start + a, start + b) for a, b, named in _long_findings(line, piece_start, piece_start + len(piece)) if not (named and judged(start + a))]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if b > a and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def find_credentials(text: str | None, path: str | None = None) -> list[tuple[int, int]]:
    """``find_spans`` of a string, as spans of code points. None or an empty text has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    spans = find_spans(raw.decode("latin-1"), path)
    if len(raw) == len(text):
        return spans
    return [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass"))) for a, b in spans]


def masked(text: str | None, spans: list[tuple[int, int]], mask: str = "*****") -> str | None:
    """The text with each span replaced; all else, line breaks and byte order marks too, stays as it was."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], mask]
        at = b
    return "".join([*parts, text[at:]])


def _hinted(text: Column) -> Column:
    low = F.lower(text)
    some = low.contains("://") & low.contains("@") | F.replace(low, F.lit("tokeniz"), F.lit("")).contains("token") | low.contains("private key")
    for h in HINTS:
        some = some | low.contains(h)
    return some


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str | None, str | None]]:
    """Each row's text, a character for a byte, and its path; columns 1 and 2."""
    paths = batch.column(2).to_pylist()
    for t, p in zip(batch.column(1).cast(pa.binary()).to_pylist(), paths):
        yield None if t is None else t.decode("latin-1"), p


def _rows(df: DataFrame, key: str, text: str, path: str | None) -> DataFrame:
    return df.select(df[key].alias("_k"), df[text].alias("_t"), (df[path].cast("string") if path else F.lit(None).cast("string")).alias("_p"))


def credentials(df: DataFrame, key: str = "file_id", text: str = "content", path: str | None = None) -> DataFrame:
    """(``key``, line_no, secret): each credential, line_no from 1 by ``\\n`` alone.

    ``path`` names the column of the files' paths, whose extensions tell configuration formats; without it, as with null
    paths and names without extension, the format is told by the text alone. Null, empty and blank texts have none;
    repeated rows repeat their findings; null keys are kept.
    """
    kind = df.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, (t, p) in zip(batch.column(0).to_pylist(), _texts(batch)):
                line, at = 1, 0
                for a, b in find_spans(t, p) if t else ():
                    line, at = line + t.count("\n", at, a), a
                    out.append((k, line, t[a:b].encode("latin-1").decode("utf-8", "replace")))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (arrow_key, pa.int32(), pa.string()))], names=["_k", "line_no", "secret"])

    rows = _rows(df, key, text, path).where(_hinted(F.col("_t")))
    return rows.mapInArrow(run, f"_k {kind}, line_no int, secret string").withColumnRenamed("_k", key)


def redact(df: DataFrame, key: str = "file_id", text: str = "content", path: str | None = None) -> DataFrame:
    """(``key``, n_secrets, redacted): every row's text with its credentials masked, all other bytes as they were; one
    without any comes back as it is, and null as null. ``path`` as in ``credentials``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for t, p in _texts(batch):
                spans = find_spans(t, p) if t else []
                counts.append(len(spans))
                out.append(None if t is None else masked(t, spans).encode("latin-1"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int32()), pa.array(out, pa.binary()).cast(pa.string())], names=["_k", "n_secrets", "redacted"])

    return _rows(df, key, text, path).mapInArrow(run, f"_k {kind}, n_secrets int, redacted string").withColumnRenamed("_k", key)
