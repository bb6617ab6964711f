"""Files nobody wrote by hand for the repository they lie in: third-party copies, tool output, minified scripts, data.

Third-party copies come first. Some tell themselves, by the directory they lie in or a header that names another
project; others lost their headers and moved. So the distinct lines of those that tell themselves, of all files whatever
their extension, make an inverted index from the hash of a line to the third-party files (by name) that have it; names
with the same lines are one. What share of any other file's lines is found under one name is its containment, counted
over all lines, across repositories. A name that has t of a file's lines has one of any all but t - 1, so the rarest of
these find the names to count.

What remains is judged by its name, by comment lines that say what it is, and by how its lines and characters are
composed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvex.llm.splitting import extension
from corvex.shared import written

LEAST_LINE = 12  # characters of a line that counts
CONTAINED = 0.4  # share of a file's lines found under one third-party name
LEAST_LINES = 4

# Directory names that hold other people's code, and name parts of tools' output.
_VENDOR_DIR = re.compile(r"(?:^|/)(?:_?vendor|vendored|third[-_]?party|3rd[-_]?party|externals?|Godeps|deps|node_modules|bower_components|site-packages|Pods|Carthage|jspm_packages)/", re.I)
_TOOL_NAME = re.compile(
    r"""(?ix)(?:\.(?:min|bundle|bundled|pb|gen|g|designer|generated|chunk|prod)\.[^./]+ | _pb2(?:_grpc)?\.[^./]+ | _grpc\.[^./]+ | [._-]generated\.[^./]+ | \.lock | [.-]lock\.(?:json|ya?ml) | \.pb\.[^/]+ )$
    | ^(?:zz_generated\..+ | package-lock\.json | yarn\.lock | pnpm-lock\.yaml | go\.sum | poetry\.lock | Cargo\.lock | Gemfile\.lock | composer\.lock | npm-shrinkwrap\.json)$"""
)
_TOOL_DIR = re.compile(r"(?:^|/)(?:dist|__generated__|bazel-out|\.next|\.nuxt)/", re.I)
_COMMENT = r"^[\s﻿]*(?:\#+|//+[!/]?|--+|/\*+!?|\*+|<!--+|;+|%+|\"\"\"|''')[ \t]*"
_GENERATED = re.compile(
    _COMMENT
    + r"""(?:.{0,200}?\bcode\ generated\b.{0,200}?do\ not\ edit | .{0,200}?\bauto(?:matically)?[- ]?generated\b(?!\s+(?:rows?|reports?)) | @generated\b | .{0,80}?\bmachine[- ]generated\b
    | .{0,80}?\bgenerated\ (?:by|from|with|using)\b.{0,200}?(?:(?:do\ not|don't|never)\ (?:edit|modify|change|touch) | (?:changes|edits|modifications)\b.{0,40}?\b(?:lost|overwritten|discarded))
    | .{0,200}?(?:do\ not|don't)\ (?:edit|modify)[^;\r\n]{0,40}?\bgenerated\b
    | <auto-?generated> | automatisch\ (?:erzeugt|generiert) | généré\ automatiquement | generado\ automáticamente )""",
    re.I | re.M | re.X,
)
# Licences by their public identifiers, which name no project.
_LICENCES = r"(?:apache|mit|[al]?gpl|bsd|0bsd|mpl|epl|cddl|isc|cc0|cc-by[\w-]*|unlicense|artistic|bsl|busl|eupl|zlib|ms-[pr]l|ofl|python|psf|ruby|w3c|wtfpl|ecl|afl|osl|ncsa|postgresql|openssl|boost|upl|cecill[\w-]*|sspl|elastic|vim|x11|tcl|php|curl|libpng)"
# A header that names the project a file comes from: what was done to it, whose it is, or under whose terms.
_THIRD = re.compile(
    _COMMENT
    + rf"""(?:\w[\w.-]*\ v\d[\w.]*\ \|\ \S+\ \|\ )?(?:.{{0,80}}?\bverbatim\ copy\ of\ (?P<a>[\w.-]+) | vendored\ from\ (?:https?://)?(?P<b>[\w./@-]+) | (?:copied|taken|imported|adapted)\ from\ (?:upstream\ |https?://)(?P<c>[\w./@-]+)
    | imported\ third[- ]party\ source:?\ (?P<d>[\w.-]+) | bundled\ (?P<e>[\w.-]+)\ v?\d[\w.]*,?\ see | licensed\ under\ the\ (?P<f>[\w.-]+)\ terms\b | this\ file\ is\ part\ of\ (?:the\ )?(?P<i>[\w.+-]*\w)
    | (?:portions\ )?(?:copyright\b[\s:]*(?:\(c\)|©)?|\(c\)|©)[\s\d,–-]*(?:by\s+)?(?:the\s+)?(?P<g>\w[\w.-]*)(?:\s+(?:project|library|language))?\s+(?:contributors|authors|developers|maintainers|committers)\b
    | SPDX-License-Identifier:\s*(?!{_LICENCES}-\d)(?P<h>[\w.+-]+?)-\d )""",
    re.I | re.M | re.X,
)
_BANNER = re.compile(r"/\*!\s*[\w.@/-]+(?:\s[\w.@/ -]{0,60}?)?\s+v?\d+\.\d")
_SOURCE_MAP = re.compile(r"[#@]\s*sourceMappingURL=")
_PEM = re.compile(r"-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", re.S)
_RUN = re.compile(r"[A-Za-z0-9+/]{36,}")
_DIGITS = re.compile(r"\d+")
_HEX = re.compile(r"\b0x[0-9a-fA-F]{1,16}\b")
_WORDS = re.compile(r"\"[^\"\n]*\"|'[^'\n]*'|[\w+/=.-]+")
_SIGNS = re.compile(r"[;{}()=,<>&|]")
_BREAK = re.compile(r"\r\n|\n|\r")


def third_party_names(text: str) -> set[str]:
    """The projects that headers name; of an address the last two parts."""
    out: set[str] = set()
    for m in _THIRD.finditer(text):
        name = next(x for x in m.groups() if x).lower().strip("./-")
        out.add("/".join([p.removesuffix(".git") for p in name.split("/") if p][-2:]))
    return out


def _own(project: str, *names: str) -> bool:
    return any(p in names for p in project.split("/"))


def composition(text: str) -> str | None:
    """``minified`` or ``data`` by what lines and characters a text is made of, else None."""
    body = _PEM.sub("", text) if "-----BEGIN" in text else text
    lines = [x.strip() for x in _BREAK.split(body)]
    lines = [x for x in lines if x]
    size = sum(map(len, lines))
    if size < 40:
        return None
    runs = sum(len(x) for x in _RUN.findall(body))
    if runs > 0.55 * size or runs > 0.35 * size and len(lines) >= 8 and runs / len(lines) > 8 and _uniform(lines, 0.3):
        return "data"
    numbers = sum(map(len, _DIGITS.findall(body))) + sum(len(x) for x in _HEX.findall(body) if not x.isdigit())
    if numbers > 0.3 * size:
        return "data"
    if len(lines) >= 8 and numbers > 0.1 * size and _uniform(lines, 0.82):
        return "data"
    spaces = body.count(" ") + body.count("\t")
    longest = max(map(len, lines))
    if longest > 400 and spaces < 0.08 * size and size / len(lines) > 120 and len(_SIGNS.findall(body)) > 0.06 * size:
        return "minified"
    return None


def _uniform(lines: list[str], share: float) -> bool:
    shapes = Counter(_WORDS.sub("w", x)[:200] for x in lines)
    return shapes.most_common(1)[0][1] >= share * len(lines)


def judge(path: str | None, text: str, owner: str, repository: str) -> tuple[bool, list[str], str | None]:
    """What a file tells itself: whether it lies among other people's code, the other projects its headers name, and the
    reason by its name, its comments and its composition."""
    name = (path or "").rpartition("/")[2]
    if _TOOL_NAME.search(name) or _TOOL_DIR.search(path or "") or _GENERATED.search(text):
        rest = "tool_output"
    elif _BANNER.match(text.lstrip("﻿ \t\r\n")) or _SOURCE_MAP.search(text[-400:]):
        rest = "minified"
    else:
        rest = composition(text)
    projects = sorted(p for p in third_party_names(text) if p and not _own(p, owner.lower(), repository.lower()))
    return bool(_VENDOR_DIR.search(path or "")), projects, rest


def line_hashes(text: str) -> np.ndarray:
    """Distinct hashes of the lines that count, white space around and inside them aside."""
    seen = {x for line in _BREAK.split(text) if len(x := "".join(line.split())) >= LEAST_LINE}
    return np.frombuffer(b"".join(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest() for x in seen), np.int64)


def listed(files: DataFrame, config: DataFrame) -> Column:
    """True for files whose extension is listed for the provider, the first part of the index name. ``config`` is a
    settings table of one row for each provider; its lists become a literal."""
    lists: dict[str, set] = {}
    for r in config.select("provider", "index_extensions").collect():  # one row for each provider
        if r["provider"] is not None:
            lists.setdefault(r["provider"].lower(), set()).update(x.strip().lower().removeprefix(".") for x in r["index_extensions"] or () if x)
    provider, ext = F.lower(F.split_part(files["index_name"], F.lit("/"), F.lit(1))), extension(files["path"])
    some = F.lit(False)
    for p, extensions in sorted(lists.items()):
        if extensions:
            some = some | ((provider == p) & ext.isin(*sorted(extensions)))
    return F.coalesce(some, F.lit(False))


def not_handwritten(files: DataFrame, config: DataFrame, key: str = "file_id") -> DataFrame:
    """(``key``, reason): the listed files that are third-party, tool output, minified or data.

    ``files`` has ``key``, index_name, path and content. Null, empty and blank contents are judged by name and path
    alone; null paths have no extension and so aren't listed; repeated rows count once, a null key takes no part.
    """
    kind = files.schema[key].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    rows = files.select(files[key].alias("_k"), files["index_name"].alias("_i"), files["path"].alias("_p"), F.coalesce(files["content"], F.lit("")).alias("_t"), listed(files, config).alias("_l")).where("_k is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = [], []
            for k, i, p, t, asked in zip(*(batch.column(j).to_pylist() for j in range(5))):
                _, owner, repository = (*(i or "").split("/"), "", "", "")[:3]
                marked, projects, rest = judge(p, t, owner, repository)
                lists.append(line_hashes(t))
                out.append((k, owner.lower(), asked, marked, projects or None, rest, (p or "").rpartition("/")[2].lower()))
            if out:
                types = (arrow_key, pa.string(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.string(), pa.string())
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))], names=["_k", "owner", "listed", "marked", "projects", "rest", "name", "lines"])

    schema = f"_k {kind}, owner string, listed boolean, marked boolean, projects array<string>, rest string, name string, lines array<long>"
    judged = written(rows.mapInArrow(run, schema), "judged")

    # A header that names the owner of some repository is a fork's, if that owner has as much of the file's lines.
    headed = judged.where("projects is not null and not marked").select("_k", F.size("lines").alias("n"), "lines", F.explode("projects").alias("project"))
    owners = judged.select("owner").distinct()
    named = written(headed.withColumn("owner", F.explode(F.split("project", "/"))).join(owners, "owner", "left_semi").distinct(), "named")
    theirs = judged.where("not marked").join(named.select("owner").distinct(), "owner", "left_semi").select("owner", F.explode("lines").alias("line")).distinct()
    lines = named.select("_k", "n", "project", "owner", F.explode("lines").alias("line")).distinct()
    forks = lines.join(theirs, ["owner", "line"], "left_semi").groupBy("_k", "n", "project", "owner").agg(F.count("*").alias("m")).where(f"m >= {CONTAINED} * n")
    foreign = headed.select("_k", "project").distinct().join(forks.select("_k", "project"), ["_k", "project"], "left_anti").select("_k").distinct()

    told = written(judged.where("marked").select("_k").unionByName(foreign).distinct(), "told")
    index = written(judged.join(told, "_k", "left_semi").select("name", F.explode("lines").alias("line")).distinct(), "index")
    # Names with the same lines, as of renamed copies, count as one; order does not change a bit_xor.
    alike = index.groupBy("name").agg(F.count("*").alias("c"), F.bit_xor("line").alias("x"), F.bit_xor(F.xxhash64("line")).alias("y")).groupBy("c", "x", "y").agg(F.min("name").alias("name")).select("name")
    index = written(index.join(alike, "name", "left_semi"), "sources")
    names = index.groupBy("line").agg(F.count("*").alias("m"))
    open_files = judged.where("listed").join(told, "_k", "left_anti").select("_k", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    least = F.greatest(F.lit(LEAST_LINES), F.ceil(F.expr(f"{CONTAINED} * n")))
    known = open_files.join(names, "line").distinct().withColumn("all", F.count("*").over(Window.partitionBy("_k", "n"))).where(F.col("all") >= least)
    known = written(known.withColumn("r", F.row_number().over(Window.partitionBy("_k", "n").orderBy("m", "line"))), "known")
    sought = known.where(F.col("r") <= F.col("all") - least + 1).select("_k", "n", "line").join(index, "line").select("_k", "n", "name").distinct()
    # New aliases: both sides come from one table.
    lines = known.select(F.col("_k").alias("_k"), F.col("n").alias("n"), F.col("line").alias("line"))
    held = sought.join(lines, ["_k", "n"]).join(index.select(F.col("name").alias("name"), F.col("line").alias("line")), ["name", "line"], "left_semi").groupBy("_k", "n", "name").agg(F.count("*").alias("m"))
    copies = held.where(f"m >= {LEAST_LINES} and m >= {CONTAINED} * n").select("_k")
    third = told.unionByName(copies).distinct().withColumn("third", F.lit("third_party"))
    found = judged.where("listed").select("_k", "rest").join(third, "_k", "left").select("_k", F.coalesce("third", "rest").alias("reason")).where("reason is not null")
    return found.groupBy("_k").agg(F.min("reason").alias("reason")).withColumnRenamed("_k", key)
