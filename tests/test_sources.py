import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex import errors
from corvex.plans import sync
from corvex.sources import corpus, repositories
from corvex.sources.listing import Listing


def test_read_files(spark, tmp_path):
    for path, data in {"a.py": b"x = 1", "sub/b.PY": b"y", "sub/c.rs": "é".encode(), ".git/d.py": b"z", "node_modules/e.py": b"z", "target/f.py": b"z", "g": b"z", "bad.py": b"\xff\xfe"}.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = corpus.read_files(spark, str(tmp_path), ["py", "rs"], "i")
    assert {(r.path, r.content) for r in got.collect()} == {("a.py", "x = 1"), ("sub/c.rs", "é")}
    assert corpus.read_files(spark, str(tmp_path), [], "i").count() == 0


def test_chunks_cover(spark):
    texts = [(1, ""), (2, None), (3, "a" * 512), (4, "b" * 513), (5, "".join(chr(97 + i % 26) for i in range(5000)))]
    df = spark.createDataFrame(texts, "file_id long, content string")
    rows = corpus.chunks(df).collect()
    for id, text in texts:
        own = [r.chunk for r in sorted((r for r in rows if r.file_id == id), key=lambda r: r.chunk_no)]
        assert "".join([own[0], *(c[64:] for c in own[1:])]) == text if text else not own


def test_embed(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "")], "doc_id long, text string")
    got = corpus.embed(df, lambda texts: np.array([[len(t), 1.0] for t in texts]), 2, batch=2)
    assert {r.doc_id: r.embedding for r in got.collect()} == {1: [2, 1], 2: [0, 1], 3: [0, 1]}
    with pytest.raises(Exception, match="embedder gave"):
        corpus.embed(df, lambda texts: np.zeros((7, 2)), 2).collect()
    h = np.arange(12.0).reshape(1, 3, 4)
    assert corpus.masked_mean(h, np.array([[1, 1, 0]]), False).tolist() == [[2, 3, 4, 5]]
    assert np.linalg.norm(corpus.masked_mean(h, np.array([[1, 1, 0]]))) == pytest.approx(1)


def test_addresses(spark):
    rows = [
        ("owner/repo", "", "owner", "repo", "gitea"),
        ("https://github.com/owner/repo.git", "github.com", "owner", "repo", "github"),
        ("git@gitlab.com:group/sub/repo.git", "gitlab.com", "group/sub", "repo", "gitlab"),
        ("ssh://git@bitbucket.org/owner/repo", "bitbucket.org", "owner", "repo", "bitbucket"),
        ("github.com/owner/repo/", "github.com", "owner", "repo", "github"),
        ("https://git.example/owner/repo?x=1", "git.example", "owner", "repo", "gitea"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    u = F.col("url")
    got = df.select(repositories.owner_and_name(u).alias("o")).select("o.owner", "o.name").collect()
    assert [tuple(r) for r in got] == [(r[2], r[3]) for r in rows]
    assert [r[0] for r in df.select(repositories.host_of(u)).collect()] == [r[1] for r in rows]
    assert [r[0] for r in df.select(repositories.detect_provider(u)).collect()] == [r[4] for r in rows]
    token = repositories.with_token(F.lit("https://h/x.git"), F.lit("gitlab"), F.lit("T"))
    assert spark.range(1).select(token, repositories.provider_of(F.lit("GH")), repositories.provider_of(F.lit("svn"))).first()[:] == ("https://oauth2:T@h/x.git", "github", None)


def test_signatures(spark):
    body, secret = b'{"a": 1}', "s3"
    good = repositories.sign(secret, body)
    repositories.verify("github", secret, body, "sha256=" + good)
    repositories.verify("gitlab", secret, body, secret)
    repositories.verify("gitea", None, body, None)
    for provider, signature in (("github", "sha256=0"), ("bitbucket", None), ("gitlab", good)):
        with pytest.raises(errors.SignatureError):
            repositories.verify(provider, secret, body, signature)
    df = spark.createDataFrame([(body.decode(), "sha256=" + good), (body.decode(), "sha256=00"), ("é", repositories.sign(secret, "é".encode())), (None, None)], "b string, s string")
    assert [r[0] for r in df.select(repositories.signature_ok("github", F.col("b"), F.col("s"), secret)).collect()] == [True, False, True, False]


def test_pushes(spark):
    df = spark.createDataFrame([("push",), ("Push Hook",), ("REPO:PUSH",), ("issues",), (None,)], "t string")
    assert [r[0] for r in df.select(repositories.is_push(F.col("t"))).collect()] == [True, True, True, False, False]
    assert [r[0] for r in df.select(repositories.is_push(F.col("t"), strict=True)).collect()] == [True, False, False, False, False]


def test_listing_source(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"values": [{"slug": f"r{n}{i}"} for i in range(2)]}))
    spark.dataSource.register(Listing)
    df = spark.read.format("listing").option("provider", "bitbucket").load(str(tmp_path))
    assert [json.loads(r.body)["slug"] for r in df.orderBy("page", "position").collect()] == ["r10", "r11", "r20", "r21"]
    (tmp_path / "none").mkdir()
    assert spark.read.format("listing").load(str(tmp_path / "none")).count() == 0


def test_catalogue_and_workspaces(spark):
    c = spark.createDataFrame([("a", 1, 10, 5), ("b", 2, 20, 6)], "name string, file_count long, size_bytes long, created_at int")
    new = spark.createDataFrame([("b", 9, 90, 7), ("c", 3, 30, 8)], "name string, file_count long, size_bytes long, created_at int")
    assert {tuple(r) for r in sync.upsert(c, new).collect()} == {("a", 1, 10, 5), ("b", 9, 90, 6), ("c", 3, 30, 8)}
    assert [r.name for r in sync.remove(c, "a").collect()] == ["b"]
    assert tuple(sync.totals(c.limit(0)).first()) == (0, 0, 0)
    w = spark.createDataFrame([("w", [("github", "o/r")])], "name string, repositories array<struct<provider:string,full_name:string>>")
    repo = F.struct(F.lit("github").alias("provider"), F.lit("o/r").alias("full_name"))
    two = sync.add_to_workspace(w, "w", repo)
    assert len(two.first().repositories) == 2 and not sync.remove_from_workspace(two, "w", "o/r").first().repositories
    for call in (lambda: sync.add_to_workspace(w, "x", repo), lambda: sync.remove_from_workspace(w, "w", "no/no")):
        with pytest.raises(errors.WorkspaceNotFound):
            call()
    paths = spark.createDataFrame([("/r/github/o/n/src/a.rs",), ("/r/github/o/a",), ("/x/github/o/n/a",), ("/r/github/o/n/.git/a",)], "p string")
    assert [r[0] for r in paths.select(sync.watched_root(F.col("p"), "/r/")).collect()] == ["/r/github/o/n", None, None, None]
