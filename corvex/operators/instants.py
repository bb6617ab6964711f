"""Time strings of many notations and zones as one UTC instant.

Listings repeat the same strings, so raw strings are first reduced, with their zone and date order, to a dictionary of
distinct values. Only values the persistent dictionary doesn't hold yet are parsed, once each, and appended to it; the
instants are then joined back to the rows.
"""

from __future__ import annotations

import hashlib
import inspect
import re
import zoneinfo
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache
from importlib import resources
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.shared import shared_dir

MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
UNIVERSAL = {"z", "utc", "gmt", "ut", "zulu"}
EPOCH = datetime(1970, 1, 1)

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<ap>[ap])\.?m\b\.?)?"
_ZONE = r"\s*(?P<zone>.*)"
_MONTH = r"(?P<mon>[a-z]{3})[a-z]*\.?"
_NOTATIONS = [
    re.compile(p, re.I | re.A)
    for p in (
        rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:t|\s+){_CLOCK}{_ZONE}",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})t?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE}",
        rf"(?P<n1>\d{{1,2}})(?P<sep>[-/.])(?P<n2>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}),?(?:t|\s+){_CLOCK}{_ZONE}",
        rf"(?:[a-z]+\.?,?\s+)?(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+{_MONTH},?[\s-]+(?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}",
        rf"(?:[a-z]+\.?,?\s+)?{_MONTH}\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}),?\s+{_CLOCK}{_ZONE}",
        # Of version control, C and the shell: the year comes last, a zone before or after it.
        rf"(?:[a-z]{{3,9}},?\s+)?{_MONTH}\s+(?P<d>\d{{1,2}})\s+{_CLOCK}\s+(?:(?P<early>[a-z]+(?:[+-]\d+)?)\s+)?(?P<y>\d{{4}})(?![\d:]){_ZONE}",
        rf"(?P<y>\d{{4}})-?w(?P<week>\d{{2}})-?(?P<weekday>[1-7])(?:t|\s+){_CLOCK}{_ZONE}",
        rf"(?P<y>\d{{4}})-?(?P<yearday>\d{{3}})(?:t|\s+){_CLOCK}{_ZONE}",
    )
]
_OFFSET = re.compile(r"(?:utc|gmt)?\s*([+-])(?:(\d{2}):?(\d{2})?(?::?(\d{2}))?|(\d):(\d{2})|(\d))(?:\s*\(?([a-z]+)\)?)?", re.I | re.A)
_FRACTION = re.compile(r"(\d{9,10})\.(\d+)", re.A)  # seconds since 1970
_DIGITS = {9: 1_000_000, 10: 1_000_000, 12: 1_000, 13: 1_000, 15: 1, 16: 1}


@lru_cache(maxsize=4096)
def _zone(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except Exception:
        return None


@lru_cache(maxsize=16384)
def _named_offset(zone: str, abbreviation: str, year: int) -> timedelta | None:
    """Offset that ``abbreviation`` stands for in a zone, in or around the year."""
    z = _zone(zone)
    for y in (year, year - 1, year + 1):
        for month in range(1, 13):
            t = datetime(min(max(y, 2), 9998), month, 15, tzinfo=z)
            if (t.tzname() or "").lower() == abbreviation:
                return t.utcoffset()
    return None


def parse_instant(raw: str | None, zone: str | None, date_order: str | None) -> int | None:
    """Microseconds since 1970 UTC of a time string, or None where it gives no real moment.

    White space around is ignored; finer digits are cut off. All-digit strings count seconds, milliseconds or
    microseconds by their length. Without zone, ``zone`` holds; zone abbreviations are those of ``zone``. A local time
    that occurs twice is the earlier instant, one that is skipped is read with the offset before the change. Null,
    empty, words, impossible or incomplete dates (a date without time too), year 0 and 1 and all-zero values give None.
    24:00 ends its day, and the 60th second is the first of the next minute, where a leap second may stand.
    """
    text = (raw or "").strip()
    if not text:
        return None
    if text.isascii() and text.isdigit():
        unit = _DIGITS.get(len(text))
        if unit:
            return int(text) * unit or None
    if m := _FRACTION.fullmatch(text):
        return (int(m[1]) * 1_000_000 + int(m[2][:6].ljust(6, "0"))) or None
    for notation in _NOTATIONS:
        if m := notation.fullmatch(text):
            break
    else:
        return None
    g, month, day = m.groupdict(), 1, 1
    if g.get("n1"):
        a, b = int(g["n1"]), int(g["n2"])
        day, month = (b, a) if date_order == "mdy" else (a, b)
    elif g.get("d"):
        month = MONTHS.get(g["mon"].lower(), 0) if g.get("mon") else int(g["m"])
        day = int(g["d"])
    hour, half, minute, second = int(g["h"]), (g.get("ap") or "").lower(), int(g["mi"]), int(g["s"] or 0)
    if half:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half == "p")
    fraction = int((g["f"] or "0")[:6].ljust(6, "0"))
    ends = timedelta(0)
    if (hour, minute, second, fraction) == (24, 0, 0, 0):
        hour, ends = 0, timedelta(days=1)
    elif second == 60 and minute % 15 == 14:  # offsets are multiples of a quarter of an hour
        second, fraction, ends = 59, 0, timedelta(seconds=1)
    try:
        local = datetime(int(g["y"]), month, day, hour, minute, second, fraction) + ends
        if g.get("week"):
            local = datetime.combine(date.fromisocalendar(int(g["y"]), int(g["week"]), int(g["weekday"])), local.time()) + timedelta(days=ends.days)
        elif g.get("yearday"):
            local += timedelta(days=int(g["yearday"]) - 1)
            if g["yearday"] == "000" or (local - ends).year != int(g["y"]):
                return None
    except (ValueError, OverflowError):
        return None
    if local.year <= 1:
        return None
    offset = _offset(" ".join(x for x in (g.get("early"), g["zone"]) if x and x.strip()).strip(), zone, local)
    return None if offset is None else (local - EPOCH - offset) // timedelta(microseconds=1)


def _offset(said: str, zone: str | None, local: datetime) -> timedelta | None:
    name = said.strip("[]()")
    if not name:
        z = _zone(zone)
        return None if z is None else local.replace(tzinfo=z).utcoffset()  # fold 0: the earlier, and in gaps the old offset
    if name.lower() in UNIVERSAL:
        return timedelta(0)
    if m := _OFFSET.fullmatch(name):
        hours, minutes, seconds = int(m[2] or m[5] or m[7]), int(m[3] or m[6] or 0), int(m[4] or 0)
        if hours > 18 or minutes > 59 or seconds > 59:
            return None
        return (1 if m[1] == "+" else -1) * timedelta(hours=hours, minutes=minutes, seconds=seconds)
    if "/" in name:
        z = _zone(name)
        return None if z is None else local.replace(tzinfo=z).utcoffset()
    z = _zone(zone)
    if z is None:
        return None
    for fold in (0, 1):
        t = local.replace(tzinfo=z, fold=fold)
        if (t.tzname() or "").lower() == name.lower():
            return t.utcoffset()
    return _named_offset(zone, name.lower(), local.year)


def _version() -> str:
    """Of the parser's text and of the time zones' data: what another one read is not used. A package shipped as an
    archive has its text too."""
    try:
        zones = resources.files("tzdata").joinpath("zones").read_text()
    except (ImportError, OSError):
        zones = ""
        for folder in zoneinfo.TZPATH:
            try:
                with open(f"{folder}/tzdata.zi", encoding="utf-8") as f:
                    zones = f.readline()
                    break
            except OSError:
                continue
    own = "".join(inspect.getsource(f) for f in (parse_instant, _offset, _named_offset)) + repr([n.pattern for n in _NOTATIONS]) + _OFFSET.pattern
    return hashlib.sha256((own + zones).encode()).hexdigest()[:12]


VERSION = _version()


def _parsed(values: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([parse_instant(*x) for x in zip(*columns)], pa.int64())], names=["raw", "zone", "date_order", "utc_us"])

    return values.mapInArrow(run, "raw string, zone string, date_order string, utc_us long")


def normalise_instants(rows: DataFrame, key: str, raw: str, host: str, zones: DataFrame, dictionary: str | None = None) -> DataFrame:
    """(``key``, raw, utc_us): each row's instant, null where its string gives none.

    ``zones`` (host, zone, date_order) is a settings table with one row for each host; of a repeated host the smallest
    counts. ``dictionary`` is the folder of the persistent dictionary, by default in the shared folder. Null strings are
    kept with a null instant; repeated rows repeat; an unknown host has no zone, so only strings with a zone parse.
    """
    spark = rows.sparkSession
    path = f"{dictionary or shared_dir(spark) + '/corvex-instants'}/{VERSION}"
    hosts = zones.where("host is not null").groupBy(F.col("host").alias("_h")).agg(F.min(F.struct("zone", "date_order")).alias("_z"))
    rows = rows.select(rows[key].alias("_k"), rows[raw].alias("raw"), rows[host].alias("_host")).join(hosts, F.col("_host") == F.col("_h"), "left")
    rows = rows.select("_k", "raw", F.coalesce("_z.zone", F.lit("")).alias("zone"), F.coalesce("_z.date_order", F.lit("")).alias("date_order"))
    keys = ["raw", "zone", "date_order"]

    def held() -> DataFrame | None:
        try:
            return spark.read.schema("raw string, zone string, date_order string, utc_us long").parquet(path).groupBy(*keys).agg(F.max("utc_us").alias("utc_us"))
        except AnalysisException:  # not there yet
            return None

    values, known = rows.where("raw is not null").select(*keys).distinct(), held()
    new = values if known is None else values.join(known, keys, "left_anti")
    _parsed(new).write.mode("append").parquet(path)
    spark.catalog.refreshByPath(path)
    # Rows without a string need no join; as one key they would all meet in one task.
    found = rows.where("raw is not null").join(held(), keys, "left").select("_k", "raw", "utc_us")
    none = rows.where("raw is null").select("_k", "raw", F.lit(None).cast("long").alias("utc_us"))
    return found.unionByName(none).select(F.col("_k").alias(key), "raw", "utc_us")
