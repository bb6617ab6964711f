"""Repositories of several hosts: addresses, listings, webhooks and signatures."""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvex.errors import SignatureError

#: Names by which a provider may be given.
ALIASES = {"github": "github", "gh": "github", "gitlab": "gitlab", "gl": "gitlab", "bitbucket": "bitbucket", "bb": "bitbucket", "gitea": "gitea", "forgejo": "gitea", "gogs": "gitea"}
PUSHES = ("push", "push_hook", "repo:push")


def _case(pairs: list[tuple[Column, Column | str | None]], rest: Column | None = None) -> Column:
    out = None
    for when, then in pairs:
        then = F.lit(then) if not isinstance(then, Column) else then
        out = F.when(when, then) if out is None else out.when(when, then)
    return out.otherwise(rest) if rest is not None else out


def provider_of(name: Column) -> Column:
    """Provider by any of its names, whatever the case; null for others."""
    return _case([(F.lower(name) == k, v) for k, v in ALIASES.items()])


def host_of(url: Column) -> Column:
    """Host of an https, ssh or scp-like address, lower-cased; empty if there is none."""
    scp = F.regexp_extract(url, r"^[\w.-]+@([^:/]+):", 1)
    full = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/]*@)?([^:/?#]+)", 1)
    bare = F.regexp_extract(url, r"^([\w-]+(?:\.[\w-]+)+)/", 1)
    return F.lower(_case([(scp != "", scp), (full != "", full)], bare))


def detect_provider(url: Column) -> Column:
    """Provider by parts of the host; any other host counts as gitea."""
    u = F.lower(url)
    return _case([(u.contains(p), p) for p in ("github", "gitlab", "bitbucket")], F.lit("gitea"))


def path_of(url: Column) -> Column:
    """``owner/name`` of an address or shorthand, without a trailing ``.git``; nested groups belong to the owner."""
    p = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*/|^[\w.-]+@[^:/]+:|^[\w-]+(?:\.[\w-]+)+/", "")
    return F.regexp_replace(F.regexp_replace(p, r"[?#].*$", ""), r"^/+|/+$|(?:\.git)?/*$", "")


def owner_and_name(url: Column) -> Column:
    """struct(owner, name); both null if the path has fewer than two parts."""
    p = path_of(url)
    owner, name = F.regexp_extract(p, r"^(.+)/[^/]+$", 1), F.regexp_extract(p, r"([^/]+)$", 1)
    ok = p.contains("/")
    return F.struct(F.when(ok, owner).alias("owner"), F.when(ok, name).alias("name"))


def with_token(url: Column, provider: Column, token: Column, ssh_url: Column | None = None) -> Column:
    """Clone address with the token put in; an ssh address is preferred and needs none."""
    https = _case(
        [
            (token.isNull(), url),
            (provider == "gitlab", F.regexp_replace(url, "^https://", F.concat(F.lit("https://oauth2:"), token, F.lit("@")))),
        ],
        F.regexp_replace(url, "^https://", F.concat(F.lit("https://"), token, F.lit("@"))),
    )
    return F.coalesce(ssh_url, https) if ssh_url is not None else https


def index_name(provider: Column, full_name: Column) -> Column:
    return F.concat_ws("/", provider, full_name)


def index_path(root: str, provider: Column, owner: Column, name: Column, file: str = "index.graph") -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), provider, owner, name, F.lit(file))


def _repository(provider: str, **c: Column) -> Column:
    none = F.lit(None).cast("string")
    order = ("owner", "name", "full_name", "clone_url", "ssh_url", "default_branch", "description", "language", "size_kb", "is_private", "topics")
    filled = {
        "default_branch": F.coalesce(c.get("default_branch", none), F.lit("main")),
        "size_kb": F.coalesce(c.get("size_kb", F.lit(0)), F.lit(0)).cast("bigint"),
        "is_private": F.coalesce(c.get("is_private", F.lit(False)), F.lit(False)),
        "topics": F.coalesce(c["topics"], F.array().cast("array<string>")) if "topics" in c else F.array().cast("array<string>"),
    }
    return F.struct(F.lit(provider).alias("provider"), *(filled.get(k, c.get(k, none)).alias(k) for k in order))


def from_github(rows: DataFrame) -> DataFrame:
    r = _repository(
        "github", owner=F.col("owner.login"), name=F.col("name"), full_name=F.col("full_name"), clone_url=F.col("clone_url"), ssh_url=F.col("ssh_url"),
        default_branch=F.col("default_branch"), description=F.col("description"), language=F.col("language"), size_kb=F.col("size"), is_private=F.col("private"), topics=F.col("topics"),
    )
    return rows.select("record_id", r.alias("r")).select("record_id", "r.*")


def from_gitea(rows: DataFrame) -> DataFrame:
    r = _repository(
        "gitea", owner=F.coalesce("owner.login", "owner.username", F.split_part("full_name", F.lit("/"), F.lit(1))), name=F.col("name"), full_name=F.col("full_name"), clone_url=F.col("clone_url"), ssh_url=F.col("ssh_url"),
        default_branch=F.col("default_branch"), description=F.col("description"), language=F.col("language"), size_kb=F.col("size"), is_private=F.col("private"), topics=F.col("topics"),
    )
    return rows.select("record_id", r.alias("r")).select("record_id", "r.*")


def from_gitlab(rows: DataFrame) -> DataFrame:
    r = _repository(
        "gitlab", owner=F.coalesce("namespace.full_path", "namespace.path"), name=F.col("path"), full_name=F.col("path_with_namespace"), clone_url=F.col("http_url_to_repo"), ssh_url=F.col("ssh_url_to_repo"),
        default_branch=F.col("default_branch"), description=F.col("description"), size_kb=F.expr("statistics.repository_size div 1024"), is_private=F.col("visibility") != "public", topics=F.col("topics"),
    )
    return rows.select("record_id", r.alias("r")).select("record_id", "r.*")


def from_bitbucket(rows: DataFrame) -> DataFrame:
    href = lambda name: F.get(F.filter("links.clone", lambda x: x["name"] == name), F.lit(0))["href"]
    r = _repository(
        "bitbucket", owner=F.coalesce("owner.username", "workspace.slug"), name=F.col("slug"), full_name=F.col("full_name"), clone_url=href("https"), ssh_url=href("ssh"),
        default_branch=F.col("mainbranch.name"), description=F.col("description"), language=F.col("language"), size_kb=F.expr("size div 1024"), is_private=F.col("is_private"),
    )
    return rows.select("record_id", r.alias("r")).select("record_id", "r.*")


#: What the hosts' listings hold of a repository.
_CODE_HOST = "name string, full_name string, clone_url string, ssh_url string, default_branch string, description string, language string, size bigint, updated_at string, private boolean, topics array<string>, owner struct<login:string,username:string>"
LISTED = {
    "github": _CODE_HOST,
    "gitea": _CODE_HOST,
    "gitlab": "path string, path_with_namespace string, http_url_to_repo string, ssh_url_to_repo string, default_branch string, description string, last_activity_at string, visibility string, topics array<string>, namespace struct<path:string,full_path:string>, statistics struct<repository_size:bigint>",
    "bitbucket": "slug string, full_name string, description string, language string, size bigint, updated_on string, is_private boolean, mainbranch struct<name:string>, owner struct<username:string>, workspace struct<slug:string>, links struct<clone:array<struct<name:string,href:string>>>",
}
_PROJECTIONS = {"github": from_github, "gitea": from_gitea, "gitlab": from_gitlab, "bitbucket": from_bitbucket}


def project(bodies: DataFrame, provider: str, visibility: str | None = None, body: str = "body", id: str = "record_id") -> DataFrame:
    """Repositories of one host from the JSON of its listing (``id``, ``body``): the host's projection, and only the
    ``public`` or ``private`` ones if asked, also for hosts whose listings can't be asked so. A body that is no JSON
    object is left out."""
    parsed = bodies.select(F.col(id).alias("record_id"), F.from_json(body, LISTED[provider]).alias("_j")).where("_j is not null and coalesce(_j.full_name, '') <> ''" if provider != "gitlab" else "_j is not null and _j.path_with_namespace is not null")
    rows = _PROJECTIONS[provider](parsed.select("record_id", "_j.*"))
    return rows if visibility is None else rows.where(F.col("is_private") == (visibility == "private"))


def event_kind(event_type: Column) -> Column:
    return F.replace(F.lower(event_type), F.lit(" "), F.lit("_"))


def is_push(event_type: Column, strict: bool = False) -> Column:
    """True for a push of any host; ``strict`` takes the plain word alone."""
    return F.coalesce(event_type == "push" if strict else event_kind(event_type).isin(*PUSHES), F.lit(False))


def sign(secret: str, body: bytes) -> str:
    return hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def verify(provider: str, secret: str | None, body: bytes, signature: str | None) -> None:
    """Raises SignatureError unless the signature holds, compared in constant time. Without a secret all pass; with one
    a missing signature fails for every host. GitLab sends the secret itself."""
    if secret is None:
        return
    want = secret if provider == "gitlab" else sign(secret, body)
    got = (signature or "").removeprefix("sha256=") if provider != "gitlab" else signature or ""
    if not hmac.compare_digest(want.encode(), got.encode()):
        raise SignatureError(f"bad {provider} signature")


def signature_ok(provider: str, body: Column, signature: Column, secret: str) -> Column:
    """HMAC-SHA256 of a body in SQL: two nested digests over the padded key."""
    key = hashlib.sha256(secret.encode()).digest() if len(secret.encode()) > 64 else secret.encode()
    key = key.ljust(64, b"\0")
    pad = lambda x: F.unbase64(F.lit(base64.b64encode(bytes(b ^ x for b in key)).decode()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(body, "UTF-8")), 256))
    want = F.sha2(F.concat(pad(0x5C), inner), 256)
    got = F.regexp_replace(signature, "^sha256=", "")
    return F.coalesce(signature == secret if provider == "gitlab" else got == want, F.lit(False))
