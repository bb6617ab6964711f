"""Webhooks as they arrive (headers and body) as events of one shape, by the rules of each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.sources.repositories import event_kind, signature_ok

#: Headers that carry the event type and the signature, by host.
TYPE_HEADERS = {"github": ("x-github-event",), "gitlab": ("x-gitlab-event",), "bitbucket": ("x-event-key",), "gitea": ("x-gitea-event", "x-gogs-event")}
SIGNATURE_HEADERS = {"github": ("x-hub-signature-256",), "gitlab": ("x-gitlab-token",), "bitbucket": ("x-hub-signature",), "gitea": ("x-gitea-signature", "x-gogs-signature")}

_CODE_HOST = "struct<name:string,full_name:string,clone_url:string,ssh_url:string,default_branch:string,owner:struct<login:string,username:string>>"
_REF = "ref string, before string, after string"
BODIES = {
    "github": f"{_REF}, repository {_CODE_HOST}",
    "gitea": f"{_REF}, repository {_CODE_HOST}",
    "gitlab": f"{_REF}, project struct<name:string,namespace:string,path_with_namespace:string,http_url:string,git_http_url:string,ssh_url:string,git_ssh_url:string,default_branch:string>",
    "bitbucket": "repository struct<slug:string,name:string,full_name:string,is_private:boolean,mainbranch:struct<name:string>,owner:struct<username:string>,workspace:struct<slug:string>,"
    "links:struct<clone:array<struct<name:string,href:string>>>>, push struct<changes:array<struct<new:struct<name:string,target:struct<hash:string>>,old:struct<name:string,target:struct<hash:string>>>>>",
}


def _header(headers: Column, names: tuple[str, ...]) -> Column:
    """The first of the named headers, whatever the case of its name."""
    lowered = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))
    return F.coalesce(*(F.try_element_at(lowered, F.lit(n)) for n in names))


def _repository(provider: str) -> dict[str, Column]:
    r = F.col("_b.project" if provider == "gitlab" else "_b.repository")
    if provider == "gitlab":
        return {"owner": r["namespace"], "name": r["name"], "full_name": r["path_with_namespace"], "clone_url": F.coalesce(r["git_http_url"], r["http_url"]), "ssh_url": F.coalesce(r["git_ssh_url"], r["ssh_url"]), "default_branch": r["default_branch"]}
    if provider == "bitbucket":
        href = lambda name: F.get(F.filter(r["links"]["clone"], lambda x: x["name"] == name), F.lit(0))["href"]
        owner = F.coalesce(r["owner"]["username"], r["workspace"]["slug"])
        return {"owner": owner, "name": F.coalesce(r["slug"], r["name"]), "full_name": r["full_name"], "clone_url": href("https"), "ssh_url": href("ssh"), "default_branch": r["mainbranch"]["name"]}
    owner = r["owner"]["login"] if provider == "github" else F.coalesce(r["owner"]["login"], r["owner"]["username"])
    return {"owner": owner, "name": r["name"], "full_name": r["full_name"], "clone_url": r["clone_url"], "ssh_url": r["ssh_url"], "default_branch": r["default_branch"]}


def parse(requests: DataFrame, provider: str, secret: str | None = None, id: str = "event_id") -> DataFrame:
    """(``id``, event_type, repository, ref_name, before, after, payload) of the requests (``id``, headers, body).

    A request without the host's event header, without a repository, or whose body is no JSON object gives no event.
    With a secret, one whose signature is missing or wrong gives none either. Missing texts of a repository are empty,
    its branch is ``main``; payload maps the body's first level to JSON texts.
    """
    headers = F.col("headers")
    kind = _header(headers, TYPE_HEADERS[provider])
    rows = requests.select(F.col(id).alias("_id"), kind.alias("_t"), _header(headers, SIGNATURE_HEADERS[provider]).alias("_s"), "body").where("_t is not null and body is not null")
    if secret is not None:
        rows = rows.where(signature_ok(provider, F.col("body"), F.col("_s"), secret))
    rows = rows.withColumn("_b", F.from_json("body", BODIES[provider])).where("_b.project is not null" if provider == "gitlab" else "_b.repository is not null")
    change = F.get(F.col("_b.push.changes"), F.lit(0)) if provider == "bitbucket" else None
    text = lambda c: F.coalesce(c, F.lit(""))
    r = _repository(provider)
    repository = F.struct(
        F.lit(provider).alias("provider"), *(text(r[n]).alias(n) for n in ("owner", "name", "full_name", "clone_url")), r["ssh_url"].alias("ssh_url"), F.coalesce(r["default_branch"], F.lit("main")).alias("default_branch")
    )
    return rows.select(
        F.col("_id").alias(id),
        (event_kind(F.col("_t")) if provider == "gitlab" else F.col("_t")).alias("event_type"),
        repository.alias("repository"),
        (change["new"]["name"] if provider == "bitbucket" else F.col("_b.ref")).alias("ref_name"),
        (change["old"]["target"]["hash"] if provider == "bitbucket" else F.col("_b.before")).alias("before"),
        (change["new"]["target"]["hash"] if provider == "bitbucket" else F.col("_b.after")).alias("after"),
        F.from_json("body", "map<string,string>").alias("payload"),
    )
