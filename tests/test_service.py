import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex import config, errors
from corvex.config import GraphConfig, IndexerConfig, SearchConfig
from corvex.operators import flat, graphs, hnsw
from corvex.plans import knn, service, sync
from corvex.sources import catalogue, listing, repositories, webhooks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(24)], f"i{i % 2}") for i in range(150)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, index_name string").cache()


def test_flat_graph_and_its_recall(spark, data):
    settings = GraphConfig(m=8, m0=16, ef_construction=40)
    graph = flat.build(data, settings).cache()
    assert graph.count() == 150 and graph.agg(F.max("degree")).first()[0] <= 16 and graph.where("is_entry").count() == 1
    queries = knn.query_set(data, 10)
    truth = knn.search_batch(data, queries, 5)
    # The default beam of one: the search ends when nothing is left to expand, however many steps that takes.
    found, fetched = hnsw.beam_search(graph, data, queries, flat.entries(graph), 5, GraphConfig(ef_search=16), id="vec_id", vector="embedding")
    assert knn.recall(found, truth).first()[0] >= 0.9 and fetched <= queries.count() * 150
    assert flat.build(data.limit(0), settings).count() == 0
    exact = flat.build_exact(data, settings, index="index_name")
    assert exact.count() == 150 and 8 <= exact.agg(F.max("degree")).first()[0] <= 16
    assert flat.estimated_bytes(3) == 4608 and flat.placeholder(data.select(F.col("vec_id").alias("file_id"))).first()["embedding"] == [0.0] * 384


def test_hubs_at_the_edges():
    degree = np.array([5, 1, 9, 2, 7, 3])
    assert flat.keep_hubs(degree, 4, 0.3).tolist() == [2, 0, 1, 3]
    for percentile in (0.0, 1.0):
        assert flat.keep_hubs(degree, 4, percentile).tolist() == [0, 1, 2, 3]
    assert flat.keep_hubs(degree, 6, 0.3).tolist() == list(range(6))


def test_hub_preserving_edges(spark):
    edges = spark.createDataFrame([(0, i, float(i)) for i in range(1, 7)] + [(i, 0, float(i)) for i in range(1, 7)] + [(6, i, 9.0) for i in range(1, 4)], "src long, dst long, dist double")
    kept = lambda p: {r.dst for r in graphs.hub_preserving(edges, 4, p).where("src = 0").collect()}
    assert kept(0.0) == kept(1.0) == {1, 2, 3, 4} and 6 in kept(0.1)


def test_proportional_pruning_keeps_the_first_alone(spark):
    n, c = F.array(*(F.lit(i) for i in range(6))), GraphConfig(prune_ratio=0.5, pruning="proportional")
    rows = spark.range(40).select(graphs.prune(n, c, salt=F.col("id"), degree=F.array(*(F.lit(d) for d in (1, 0, 0, 0, 0, 1000)))).alias("k")).collect()
    assert {tuple(r.k) for r in rows} <= {(0,), (5,), (0, 5)}
    assert spark.range(1).select(graphs.prune(n, c, salt=F.lit(1), degree=F.array_repeat(F.lit(0), 6)).alias("k")).first().k == [0, 1, 2]


def test_diverse_links_and_missing_nodes(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.1, 0.0]), (3, [0.0, 2.0])], "node_id long, vector array<float>")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.1), (0, 3, 2.0)], "src long, dst long, dist double")
    assert {r.dst for r in graphs.select_diverse(edges, v, 2, "euclidean").collect()} == {1, 3}
    assert graphs.vectors_of(v, v.where("node_id < 2")).count() == 2
    with pytest.raises(errors.NodeNotFound):
        graphs.vectors_of(v, spark.createDataFrame([(1,), (77,)], "node_id long"))


def test_settings_of_a_search(data):
    q = knn.vector_of(data, 0)
    assert knn.search_with(data, q, SearchConfig(top_k=3, include_vectors=True)).columns == ["vec_id", "vector", "distance"]
    assert knn.search_with(data, q, SearchConfig(top_k=5, min_similarity=0.9)).count() == 1
    with pytest.raises(errors.InvalidConfig):
        knn.search_with(data, q, SearchConfig(min_similarity=0.5), "dot")


def test_service(spark, tmp_path):
    root, embed = f"file://{tmp_path}/indexes", service.hashed_words(32)
    repository = {"provider": "github", "owner": "o", "name": "r", "full_name": "o/r", "clone_url": "https://github.com/o/r.git", "topics": ["a"]}
    other = {**repository, "name": "s", "full_name": "o/s"}
    words = ["red apple pie", "green pear tart", "blue sky at noon", "stormy sea at night", "graph of nodes"]
    files = spark.createDataFrame([(f"d/{i}.md", w) for i, w in enumerate(words)] + [("e.md", None)], "path string, content string")
    assert service.search(spark, root, ["apple"], embed).count() == 0
    did = service.sync_all(spark, root, [(repository, "c1", lambda: files), (other, "c1", lambda: files.where("path < 'd/2'"))], embed)
    assert did == {"github/o/r": "built", "github/o/s": "built"}
    assert service.sync_all(spark, root, [(repository, "c1", lambda: files)], embed) == {"github/o/r": "current"}
    born = {r.name: r.created_at for r in catalogue.indexes(spark, root).collect()}
    assert service.sync_all(spark, root, [(repository, "c2", lambda: files), ({**other, "full_name": "o/t"}, "c", lambda: files.select("nothing"))], embed)["github/o/r"] == "built"
    rows = {r.name: r for r in catalogue.indexes(spark, root).collect()}
    assert set(rows) == {"github/o/r", "github/o/s"} and rows["github/o/r"].created_at == born["github/o/r"] < rows["github/o/r"].updated_at and rows["github/o/r"].file_count == 6
    best = service.search(spark, root, ["a red apple", "the sea at night"], embed, k=2).orderBy("q_id", F.desc("score")).collect()
    assert best[0].snippet == "red apple pie" and best[0].score == best[1].score and [r.snippet for r in best if r.q_id == 1][0] == "stormy sea at night"
    assert {r["index"] for r in service.search(spark, root, ["apple"], embed, names=["github/o/s", "no/such"]).collect()} == {"github/o/s"}
    # Workspaces.
    spaces = sync.create_workspace(catalogue.workspaces(spark, root), "w", f"{root}/workspaces/w")
    kind = spaces.schema["repositories"].dataType.elementType
    member = F.struct(*(F.lit({"provider": "github", "full_name": "o/s"}.get(f.name)).cast(f.dataType).alias(f.name) for f in kind))
    assert catalogue.save(sync.add_to_workspace(spaces, "w", member), root, "workspace") == 1
    assert [tuple(r)[:2] for r in sync.list_workspaces(catalogue.workspaces(spark, root)).collect()] == [("w", 1)]
    assert {r["index"] for r in service.search(spark, root, ["apple"], embed, workspace="w").collect()} == {"github/o/s"}
    with pytest.raises(errors.WorkspaceNotFound):
        service.search(spark, root, ["apple"], embed, workspace="none")
    with pytest.raises(errors.WorkspaceNotFound):
        sync.delete_workspace(catalogue.workspaces(spark, root), "none", must=True)
    assert catalogue.delete(spark, root, "w", "workspace") and catalogue.workspaces(spark, root).count() == 0
    # An entry that can't be read is left out; removing takes the entry along.
    (tmp_path / "indexes/github/o/s/metadata.json").write_text("{ not json")
    (tmp_path / "indexes/github/o/s/.metadata.json.crc").unlink(missing_ok=True)
    assert {r.name for r in catalogue.indexes(spark, root).collect()} == {"github/o/r"}
    assert service.remove(spark, root, "github/o/r") and not service.remove(spark, root, "github/o/r")
    assert catalogue.indexes(spark, root).count() == 0


BODY = {"ref": "refs/heads/main", "before": "a1", "after": "b2", "repository": {"name": "r", "full_name": "o/r", "clone_url": "https://h/o/r.git", "ssh_url": None, "owner": {"login": "o", "username": "u"}}}
PROJECT = {"ref": "refs/heads/x", "before": "a", "after": "b", "project": {"name": "r", "namespace": "g", "path_with_namespace": "g/r", "git_http_url": "https://l/g/r.git", "git_ssh_url": "git@l:g/r.git", "default_branch": "dev"}}
CHANGES = {
    "repository": {"slug": "r", "full_name": "w/r", "workspace": {"slug": "w"}, "links": {"clone": [{"name": "https", "href": "https://b/w/r.git"}]}},
    "push": {"changes": [{"new": {"name": "main", "target": {"hash": "n"}}, "old": None}]},
}


@pytest.mark.parametrize(
    "provider, header, body, want",
    [
        ("github", {"X-GitHub-Event": "push"}, BODY, ("push", "o", "o/r", "main", "refs/heads/main", "a1", "b2")),
        ("gitea", {"x-gogs-event": "push"}, {**BODY, "repository": {**BODY["repository"], "owner": {"username": "u"}}}, ("push", "u", "o/r", "main", "refs/heads/main", "a1", "b2")),
        ("gitlab", {"x-gitlab-event": "Push Hook"}, PROJECT, ("push_hook", "g", "g/r", "dev", "refs/heads/x", "a", "b")),
        ("bitbucket", {"x-event-key": "repo:push"}, CHANGES, ("repo:push", "w", "w/r", "main", "main", None, "n")),
    ],
)
def test_webhooks(spark, provider, header, body, want):
    text = json.dumps(body)
    signed = {**header, webhooks.SIGNATURE_HEADERS[provider][0]: "S" if provider == "gitlab" else "sha256=" + repositories.sign("S", text.encode())}
    rows = [(1, header, text), (2, {}, text), (3, header, "{"), (4, header, "{}"), (5, header, None), (6, None, text), (7, signed, text)]
    requests = spark.createDataFrame(rows, "event_id long, headers map<string,string>, body string")
    got = {r.event_id: (r.event_type, r.repository.owner, r.repository.full_name, r.repository.default_branch, r.ref_name, r.before, r.after) for r in webhooks.parse(requests, provider).collect()}
    assert got == {1: want, 7: want}
    assert [r.event_id for r in webhooks.parse(requests, provider, "S").collect()] == [7]
    assert set(webhooks.parse(requests, provider).first().payload) == set(body)


def test_listing_pages_statuses_and_projection(spark, tmp_path):
    for i in (1, 2, 3):
        page = {"values": [{"slug": f"r{i}", "full_name": f"w/r{i}", "is_private": i == 2, "size": 2048, "workspace": {"slug": "w"}}], **({"next": f"https://h/page-{i + 1}.json"} if i < 2 else {})}
        (tmp_path / f"page-{i}.json").write_text(json.dumps(page))
    spark.dataSource.register(listing.Listing)
    rows = spark.read.format("listing").option("provider", "bitbucket").load(str(tmp_path)).select(F.col("page").cast("long").alias("record_id"), "body")
    assert rows.count() == 2  # the second names no next page
    bodies = rows.unionByName(spark.createDataFrame([(9, "no json"), (8, None)], "record_id long, body string"))
    assert {(r.record_id, r.full_name, r.size_kb, r.is_private) for r in repositories.project(bodies, "bitbucket").collect()} == {(1, "w/r1", 2, False), (2, "w/r2", 2, True)}
    assert [r.record_id for r in repositories.project(bodies, "bitbucket", "private").collect()] == [2]
    hub = spark.createDataFrame([(1, json.dumps({"name": "r", "full_name": "o/r", "clone_url": "u", "owner": {"login": "o"}, "size": 7, "topics": ["t"]}))], "record_id long, body string")
    r = repositories.project(hub, "github").first()
    assert (r.provider, r.owner, r.default_branch, r.size_kb, r.is_private, r.topics) == ("github", "o", "main", 7, False, ["t"])
    listing.check(204)
    for status, error in ((404, errors.NotFound), (401, errors.AuthenticationFailed), (403, errors.AuthenticationFailed), (429, errors.RateLimited), (500, errors.ApiError)):
        with pytest.raises(error):
            listing.check(status)
    waits, answers = [], [lambda: listing.check(429, {"Retry-After": "7"}), lambda: listing.check(429), lambda: "ok"]
    assert listing.with_retry(lambda: answers.pop(0)(), waits.append) == "ok" and waits == [7, 60]


def test_config_sources(tmp_path):
    assert config.from_environment(environment={"CORVEX_STORAGE__REPOS_PATH": "/a", "CORVEX_MAX_CONCURRENT_SYNCS": "9", "CORVEX_EXTENSIONS": "py, rs"}) == IndexerConfig(repos_path="/a", max_concurrent_syncs=9, extensions=("py", "rs"))
    (tmp_path / "c.json").write_text('{"indexer": {"sync_interval_secs": 5}, "extensions": ["md"]}')
    assert config.from_file(str(tmp_path / "c.json")) == IndexerConfig(sync_interval_secs=5, extensions=("md",))
    (tmp_path / "c.yaml").write_text("# settings\nrepos_path: /r\nextensions:\n  - py\n  - go\n")
    assert config.from_file(str(tmp_path / "c.yaml")) == IndexerConfig(repos_path="/r", extensions=("py", "go"))
    for text in ("{", '{"what": 1}'):
        (tmp_path / "bad.json").write_text(text)
        with pytest.raises(errors.InvalidConfig):
            config.from_file(str(tmp_path / "bad.json"))
    assert config.EmbedderConfig("jina-base").dimension == 768 and config.probe(service.hashed_words(16)) == 16
    with pytest.raises(errors.InvalidConfig):
        config.probe(lambda texts: [[]])


def test_watched_events(spark):
    rows = spark.createDataFrame([("Create", "/d/g/o/r/a.py"), ("access", "/d/g/o/r/a.py"), ("remove", "/d/g/o/r/.git/x"), ("modify", "/e/x")], "kind string, path string")
    assert [tuple(r) for r in sync.watched_events(rows, "/d").collect()] == [("Create", "/d/g/o/r/a.py", "/d/g/o/r")]
