"""Groups of texts whose sets of word runs overlap, without comparing every text with every other.

Texts with the same set form a class. Tokens (hashed word runs) have one global order: the rare ones by hash, then the
frequent ones by rising document frequency. The first t tokens that two similar sets share lie in the prefixes of both,
which are t - 1 longer than for one token. If the prefix of ``SHARED`` shared tokens holds rare tokens alone, these are all
rare, and both classes meet under each of them: pairs that meet less often aren't candidates. Else one rare token is
enough, or, if all they share is frequent, two frequent ones of one class of tokens: the frequent tokens of a prefix that
holds t = c + 1 shared ones fall into c classes by their hash, two of the shared ones into the same, and only pairs within
a class are indexed. c grows with the size of the sets, so their keys do not grow with its square: about
``CLASS`` / 2 for each frequent token. Both sets take the c of the larger one's power of two. Candidates are verified on
40-bit hashes of their tokens, at a threshold where a chance collision would have to decide.

Frequencies are counted over all texts. The order needs the most frequent tokens alone, at most ``FREQUENT_TOKENS``; any
consistent order gives the same result. Frequent tokens beyond that number are found by a join, and count as frequent too.
Keys of many classes are joined in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvex.llm.components import components
from corvex.llm.rolling import mix
from corvex.llm.shingle import shingle_sets
from corvex.shared import written

FREQUENT_DF = 24  # a token in at least so many texts counts as frequent
FREQUENT_TOKENS = 1 << 17  # at most so many are sent to each executor: 1 MB; others that are frequent are joined
SHARED = 4  # shared tokens that the prefixes are long enough for
CLASS = 8  # frequent tokens of a prefix that share a class, about
POSTING = 1000  # classes under one key that are compared in one piece
BLOOM_BITS = 1 << 23  # of the filter for the texts whose sets are asked for: 1 MB, whatever their number
BLOCK_BYTES = 1_000_000
FLUSH_TOKENS = 1_500_000


def _sets(batches: Iterator[pa.RecordBatch], width: int, least_words: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and sets of the texts with at least ``least_words`` words, block by block."""

    def out(keys: list, texts: list[bytes]) -> tuple[list, list[np.ndarray]]:
        sets, words = shingle_sets(texts, width)
        keep = [i for i, n in enumerate(words) if n >= max(least_words, width)]
        return [keys[i] for i in keep], [sets[i] for i in keep]

    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_buffer() if k is not None and t.is_valid else None
            if t is None:
                continue
            keys.append(k)
            texts.append(t.to_pybytes())
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield out(keys, texts)
                keys, texts, size = [], [], 0
    if keys:
        yield out(keys, texts)


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted 40-bit numbers as differences, byte plane by byte plane: what shuffles compress best."""
    steps = np.diff(numbers, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.zeros((len(data) // 5, 8), np.uint8)
    planes[:, :5] = np.frombuffer(data, np.uint8).reshape(5, -1).T
    return np.cumsum(planes.view(np.uint64).ravel(), dtype=np.uint64)


def frequent_tokens(texts: DataFrame, width: int, least_words: int) -> DataFrame:
    """(token, df): the frequent tokens (first 32 bits of their hash) and the number of texts that have them.

    Counted over all texts: a task sends its tokens as sorted differences by range of the hash, about 2 bytes each, and
    each range, whose size doesn't grow with the corpus as their number does, is merged and counted in one piece.
    """
    ranges = 4
    while ranges < 4 * max(8, texts.rdd.getNumPartitions()) and ranges < 1 << 16:
        ranges *= 2
    shift = 32 - (ranges.bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            cuts = np.searchsorted(tokens, np.arange(1, ranges, dtype=np.uint64) << np.uint64(shift))
            parts = [(i, p) for i, p in enumerate(np.split(tokens, cuts)) if len(p)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([_packed(p) for _, p in parts], pa.binary())], names=["part", "tokens"])

        held, n = [], 0
        for _, sets in _sets(batches, width, least_words):
            held += [s >> np.uint64(32) for s in sets]
            n += sum(map(len, sets))
            if n >= FLUSH_TOKENS:
                yield out(held)
                held, n = [], 0
        if n:
            yield out(held)

    def merge(table: pa.Table) -> pa.Table:
        tokens, n = np.unique(np.concatenate([_unpacked(x) for x in table.column("tokens").to_pylist()]), return_counts=True)
        often = n >= FREQUENT_DF
        return pa.table({"token": tokens[often].astype(np.int64), "df": n[often].astype(np.int64)})

    return written(texts.mapInArrow(count, "part int, tokens binary").groupBy("part").applyInArrow(merge, "token long, df long"), "frequent")


def _least(n: int, share: float) -> int:
    return max(1, int(np.ceil(share * n - 1e-9)))


def levels(n: int, share: float) -> list[int]:
    """The powers of two below a set's size and those of its larger partners."""
    return list(range(n.bit_length() - 1, int(n / share + 1e-9).bit_length()))


def classes(level: int, share: float) -> int:
    """Classes of frequent tokens for sets of which the larger has 2^level to 2^(level + 1) tokens; fewer than such sets
    must share."""
    least = _least(_least(1 << level, share), share)
    return max(1, min(int((1 << level) * (1 - share) / CLASS), least - 1))


def prefix(tokens: np.ndarray, share: float, frequent: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """The longest prefix of a set that is needed, in order, and how many of it are rare."""
    n = len(tokens)
    needed = _least(n, share)
    shared = max(SHARED, *(classes(x, share) + 1 for x in levels(n, share)))
    high = tokens >> np.uint64(32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
        often = frequent[at] == high
    else:
        often = np.zeros(n, bool)
    rare, f = tokens[~often], tokens[often]
    most = min(n, n - needed + min(shared, needed))
    if len(rare) >= most:
        return rare[:most], most
    return np.concatenate([rare, f[np.lexsort((f, order[at[often]]))]])[:most] if len(f) else rare, len(rare)


def keys_of(head: np.ndarray, rare: np.ndarray, n: int, share: float) -> tuple[np.ndarray, int, bool]:
    """What a set of n tokens is indexed under, by its prefix and which of that is rare: rare tokens singly, and pairs of
    frequent ones of a class; how many of these keys are rare tokens; and whether the prefix of SHARED shared tokens has
    rare tokens alone."""
    needed = _least(n, share)
    pure = n - needed + min(SHARED, needed)
    if rare[:pure].all():
        return head[:pure], min(pure, len(head)), True
    singles = head[rare]
    pairs = [head] if needed < 2 else []  # so small a set may share a single token
    place = np.arange(len(head))
    for level in levels(n, share):
        c = classes(level, share)
        f = head[~rare & (place < n - needed + c + 1)]
        kind = (mix(f) % np.uint64(c)).astype(np.int64)
        by_kind = np.argsort(kind, kind="stable")
        f, kind = np.sort(f[by_kind]) if c == 1 else f[by_kind], kind[by_kind]
        for part in np.split(f, np.flatnonzero(np.diff(kind)) + 1) if len(f) else ():
            part = np.sort(part)
            i, j = np.triu_indices(len(part), 1)
            with np.errstate(over="ignore"):
                pairs.append(mix((part[i] * np.uint64(0xD6E8FEB86659FD93) + part[j]) ^ mix(np.full(len(i), level, np.uint64))))
    return np.concatenate([singles, *pairs]), len(singles), False


def _class(tokens: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(mix(tokens + np.uint64(1)))) ^ int(tokens.sum(dtype=np.uint64))


def _bloom(keys: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter of BLOOM_BITS bits; at most BLOOM_BITS / 64 rows reach the driver."""
    bits = F.explode(F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(BLOOM_BITS)) for seed in (1, 2))))
    words = keys.select(bits.alias("b")).select((F.col("b") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(b % 64 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    got, out = words.toPandas(), np.zeros(BLOOM_BITS // 64, np.int64)
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return out


def _met(a: DataFrame, b: DataFrame, on: list[str], share: float) -> DataFrame:
    """(cls_a, cls_b, e): classes under one key whose sizes allow them to be similar, and how often they must meet."""
    n_a, n_b = F.expr("s_a div 4"), F.expr("s_b div 4")
    fits = (n_a >= share * n_b - 1e-9) & (n_b >= share * n_a - 1e-9)
    needed = F.least(F.lit(SHARED), F.greatest(F.lit(1), F.ceil(share * F.least(n_a, n_b) - 1e-9)))
    enough = F.when((F.col("s_a") % 4 > 0) & (F.col("s_b") % 4 > 0), 1).otherwise(needed)
    return a.join(b, on).where(F.col("cls_a") < F.col("cls_b")).where(fits).select("cls_a", "cls_b", enough.cast("int").alias("e"))


def _in_blocks(posted: DataFrame, share: float) -> DataFrame:
    """The same for keys of ``count`` classes, in blocks of about POSTING of them against each other."""
    posted = written(posted.withColumn("parts", F.ceil(F.col("count") / POSTING).cast("int")).withColumn("at", F.expr("cast(pmod(xxhash64(cls), parts) as int)")), "crowds")
    spread = F.explode(F.expr("sequence(0, parts - 1)"))
    a = posted.select(F.col("cls").alias("cls_a"), "token", F.col("s").alias("s_a"), F.col("at").alias("i"), spread.alias("j"))
    b = posted.select(F.col("cls").alias("cls_b"), F.col("token").alias("token"), F.col("s").alias("s_b"), spread.alias("i"), F.col("at").alias("j"))
    return _met(a, b, ["token", "i", "j"], share)


def similar_classes(df: DataFrame, key: str, text: str, share: float = 0.7, width: int = 3, least_words: int = 40) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): ``members`` has (``_k``, ``cls``), one row for each text with enough words; ``pairs`` has
    (``cls_a``, ``cls_b``), the classes whose sets share at least ``share`` of all their distinct word runs.

    Null and shorter texts are in neither; null keys take no part; repeated rows count once. A class holds all texts of
    one set, so copies, however many, are compared once.
    """
    spark = df.sparkSession
    texts = df.select(df[key].alias("_k"), df[text].alias("_t")).where("_k is not null and _t is not null")
    kind = texts.schema["_k"].dataType.simpleString()
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    counted = frequent_tokens(texts, width, least_words)
    top = counted.orderBy(F.desc("df"), "token").limit(FREQUENT_TOKENS).toPandas()  # at most FREQUENT_TOKENS rows
    token = top["token"].to_numpy(np.uint64)
    by_token = np.argsort(token)
    table = spark.sparkContext.broadcast((token[by_token], (len(token) - by_token).astype(np.int64)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, order = table.value
        for keys, sets in _sets(batches, width, least_words):
            heads = [prefix(s, share, frequent, order) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(h) for h, _ in heads])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, arrow_key),
                    pa.array(np.array([_class(s) for s in sets], np.uint64).view(np.int64)),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([m for _, m in heads], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([h for h, _ in heads]).view(np.int64) if heads else np.zeros(0, np.int64))),
                ],
                names=["_k", "cls", "n", "rare", "head"],
            )

    indexed = written(texts.mapInArrow(index, f"_k {kind}, cls long, n int, rare int, head array<long>"), "prefixes")
    members = indexed.select("_k", "cls").distinct()
    heads = indexed.withColumn("more", F.lit(None).cast("array<long>"))
    if len(top) == FREQUENT_TOKENS:
        # The frequent tokens that were not sent: each class that takes one for rare learns of it.
        others = counted.join(spark.createDataFrame(top[["token"]]), "token", "left_anti")
        taken = indexed.select("cls", F.explode(F.slice("head", F.lit(1), F.col("rare"))).alias("t")).distinct()
        taken = taken.withColumn("token", F.shiftrightunsigned("t", 32)).join(others.select("token"), "token", "left_semi")
        heads = indexed.join(taken.groupBy("cls").agg(F.collect_set("t").alias("more")), "cls", "left")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for cls, n, m, head, more in zip(*(batch.column(i) for i in range(5))):
                tokens = head.values.to_numpy().view(np.uint64)
                rare = np.arange(len(tokens)) < m.as_py()
                if more.is_valid:
                    rare &= ~np.isin(tokens, more.values.to_numpy().view(np.uint64))
                keys, singles, pure = keys_of(tokens, rare, n.as_py(), share)
                # One number for a key's size and kind: 4n, and 1 or 2 more where a single meeting is enough.
                kinds = np.where(np.arange(len(keys)) >= singles, 2, 0 if pure else 1) + 4 * n.as_py()
                held.append((np.full(len(keys), cls.as_py(), np.int64), keys.view(np.int64), kinds.astype(np.int32)))
                size += len(keys)
                if size >= 200_000:
                    yield posting(held)
                    held, size = [], 0
            if held:
                yield posting(held)

    def posting(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(3)], names=["cls", "token", "s"])

    # Copies have the same prefix; a class that comes more than once brings its keys once.
    posted = heads.select("cls", "n", "rare", "head", "more").mapInArrow(post, "cls long, token long, s int").repartition("token").dropDuplicates(["token", "cls"])
    columns = ("cls", "token", "s")
    if len(top) and int(top["df"].max()) > POSTING:
        crowded = written(posted.groupBy("token").count().where(F.col("count") > POSTING), "crowded")
        if not crowded.isEmpty():
            met = _in_blocks(posted.join(crowded, "token"), share)
            posted = posted.join(crowded, "token", "left_anti").select(*columns)
        else:
            met = None
    else:
        met = None
    calm = _met(posted.toDF("cls_a", "token", "s_a"), posted.select(*(F.col(c).alias(c) for c in columns)).toDF("cls_b", "token", "s_b"), ["token"], share)
    met = calm if met is None else calm.unionByName(met)
    pairs = written(met.groupBy("cls_a", "cls_b").agg(F.count("*").alias("m"), F.min("e").alias("e")).where("m >= e").select("cls_a", "cls_b"), "candidates")

    # One text of each class that has a candidate brings its set; a few others that pass the filter do no harm.
    asked = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
    asked = members.join(asked, "cls").groupBy("cls").agg(F.min("_k").alias("_r"))
    bloom = spark.sparkContext.broadcast(_bloom(asked, "_r"))
    places = F.array(*(F.pmod(F.xxhash64(F.lit(seed), F.col("_k")), F.lit(BLOOM_BITS)) for seed in (1, 2)))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column(2).flatten().to_numpy().reshape(-1, 2)
                yield batch.filter(pa.array((bloom.value[at >> 6] >> (at & 63) & 1).all(axis=1)))

        for _, sets in _sets(asked_for(batches), width, least_words):
            yield pa.RecordBatch.from_arrays([pa.array(np.array([_class(s) for s in sets], np.uint64).view(np.int64)), pa.array([_packed(s >> np.uint64(24)) for s in sets], pa.binary())], names=["cls", "tokens"])

    sets = written(texts.select("_k", "_t", places.alias("_at")).mapInArrow(sets_of, "cls long, tokens binary"), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["cls_a", "cls_b"]).filter(pa.array(good, pa.bool_()))

    first = pairs.join(sets.toDF("cls_a", "tokens_a"), "cls_a").join(sets.toDF("cls_b", "tokens_b"), "cls_b")
    checked = first.select("cls_a", "cls_b", "tokens_a", "tokens_b").mapInArrow(verify, "cls_a long, cls_b long").distinct()
    return members, written(checked, "links")


def similar_pairs(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(``a``, ``b``), a < b: all pairs of keys whose texts are similar, copies included. For a result whose size
    follows the texts, not the pairs, use ``similar_groups``."""
    members, pairs = similar_classes(df, key, text, **options)
    left, right = members.toDF("x", "cls_a"), members.toDF("y", "cls_b")
    across = pairs.join(left, "cls_a").join(right, "cls_b")
    within = left.join(right, left["cls_a"] == right["cls_b"]).where("x < y")
    return across.select("x", "y").unionByName(within.select("x", "y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b")


def similar_groups(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """(``key``, group_key, n_links): each text with enough words, the smallest key of its group (texts connected by
    similarity, directly or through others), and with how many other texts it is similar itself."""
    members, pairs = similar_classes(df, key, text, **options)
    members = written(members, "members")
    sizes = members.groupBy("cls").agg(F.count("*").alias("size"), F.min("_k").alias("least"))
    both = pairs.unionByName(pairs.select(F.col("cls_b").alias("cls_a"), F.col("cls_a").alias("cls_b")))
    links = both.join(sizes.select(F.col("cls").alias("cls_b"), "size"), "cls_b").groupBy(F.col("cls_a").alias("cls")).agg(F.sum("size").alias("linked"))
    group = components(pairs.toDF("u", "v")).withColumnRenamed("u", "cls")
    whole = sizes.join(group, "cls", "left").join(links, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = whole.groupBy("root").agg(F.min("least").alias("group_key"))
    out = whole.join(least, "root").select("cls", "group_key", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_links"))
    return members.join(out, "cls").select(F.col("_k").alias(key), "group_key", "n_links")
