"""Feed and catalog sources: XML entries, URL policy, JSON catalogs, JSON lines."""

from __future__ import annotations

import ipaddress
from email.utils import parsedate_to_datetime
from datetime import datetime, timezone
from urllib.parse import urljoin, urlsplit
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<external_id:string,title:string,link:string,summary:string,content:string,author:string,published_s:bigint,categories:array<string>,enclosures:array<struct<url:string,content_type:string,length_bytes:bigint>>,updated_s:bigint,provider:string>"
FEED = f"struct<format:string,title:string,error:string,entries:array<{ENTRY}>>"
#: Longest body that is read at all.
MAX_BYTES = 10 << 20


def _name(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2].lower() if isinstance(node.tag, str) else ""


def _first(node: ElementTree.Element, *names: str) -> str | None:
    """Text of the first child, in the order of names, that isn't blank."""
    for wanted in names:
        for child in node:
            if _name(child) == wanted and (text := "".join(child.itertext()).strip()):
                return text
    return None


def _seconds(value: str | None) -> int | None:
    if not value:
        return None
    for read in (parsedate_to_datetime, lambda v: datetime.fromisoformat(v.replace("Z", "+00:00"))):
        try:
            at = read(value)
            return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp())
        except (ValueError, TypeError, OverflowError):
            continue
    return None


def _link(node: ElementTree.Element, base: str) -> str | None:
    """The plain link, else the alternate one, else the first; absolute."""
    plain = _first(node, "link")
    links = [c for c in node if _name(c) == "link" and c.get("href")]
    href = plain or next((c.get("href") for c in links if c.get("rel", "alternate") == "alternate"), None) or (links[0].get("href") if links else None)
    return urljoin(base, href) if href else None


def _provider(node: ElementTree.Element) -> str | None:
    """Who supplied the entry: its source's title or name, or text, else its publisher."""
    for c in node:
        if _name(c) == "source" and (name := _first(c, "title", "name") or (c.text or "").strip()):
            return name
    return _first(node, "publisher")


def _enclosures(node: ElementTree.Element, base: str) -> list[dict]:
    out = []
    for c in node:
        url = c.get("url") if _name(c) == "enclosure" else c.get("href") if _name(c) == "link" and c.get("rel") == "enclosure" else None
        if url:
            size = c.get("length", "")
            out.append({"url": urljoin(base, url), "content_type": c.get("type"), "length_bytes": int(size) if size.isdigit() else None})
    return out


def parse_feed(data: str | None, base: str = "") -> dict:
    """Format, title, error and entries of an RSS or Atom document."""
    nothing = {"format": None, "title": None, "error": None, "entries": []}
    if not data or len(data) > MAX_BYTES // 4 and len(data.encode()) > MAX_BYTES:
        return nothing | {"error": "empty or too long"}
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        return nothing | {"error": str(e)}
    kind = {"rss": "rss", "rdf": "rss", "feed": "atom"}.get(_name(root))
    if not kind:
        return nothing | {"error": f"no feed: {_name(root)}"}
    top = root if kind == "atom" else next((c for c in root if _name(c) == "channel"), root)
    entries = []
    for node in root.iter():
        if _name(node) not in ("item", "entry"):
            continue
        tags = [t for c in node if _name(c) == "category" if (t := (c.get("term") or "".join(c.itertext())).strip())]
        author = next((c for c in node if _name(c) == "author"), None)
        by = (_first(author, "name") if author is not None and len(author) else None) or _first(node, "author", "creator")
        entries.append(
            {
                "external_id": _first(node, "id", "guid"),
                "title": _first(node, "title"),
                "link": _link(node, base),
                "summary": _first(node, "description", "summary"),
                "content": _first(node, "encoded", "content"),
                "author": by,
                "published_s": _seconds(_first(node, "pubdate", "published", "issued", "created")),
                "categories": list(dict.fromkeys(tags)),
                "enclosures": _enclosures(node, base),
                "updated_s": _seconds(_first(node, "updated", "modified", "date")),
                "provider": _provider(node),
            }
        )
    return {"format": kind, "title": _first(top, "title"), "error": None, "entries": entries}


def _parse_rows(data: pd.Series, base: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_feed(d, b or "") for d, b in zip(data, base, strict=True)], columns=["format", "title", "error", "entries"])


def parsed(data: Column | str, base: Column | str) -> Column:
    """Feed struct of XML text and its URL.  The UDF is made here: its type needs a session."""

    def rows(d: pd.Series, b: pd.Series) -> pd.DataFrame:
        return _parse_rows(d, b)

    return F.pandas_udf(rows, FEED)(data, base)


def entries(feeds: DataFrame) -> DataFrame:
    """A row an entry.  feeds: (feed_id, url, content)."""
    return feeds.select("feed_id", parsed("content", "url").alias("feed")).select("feed_id", F.col("feed.format").alias("format"), F.posexplode("feed.entries").alias("pos", "e")).select("feed_id", "format", "pos", "e.*")


def identity(entry_columns: DataFrame) -> DataFrame:
    """Adds identity_type and identity_key: guid, else link, else title, time and author."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    guid, link = clean(F.col("external_id")), clean(F.col("link"))
    at = F.coalesce(F.date_format(F.timestamp_seconds("published_s"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(""))
    own = F.concat_ws("\x1f", F.coalesce(clean(F.col("title")), F.lit("")), at, F.coalesce(clean(F.col("author")), F.lit("")))
    kind = F.when(guid.isNotNull(), "guid").when(link.isNotNull(), "link").otherwise("derived")
    rows = entry_columns.withColumn("identity_type", kind)
    return rows.withColumn("identity_key", F.sha2(F.concat_ws("\x00", "identity_type", F.coalesce(guid, link, own)), 256))


def url_allowed(url: str | None) -> bool:
    """http(s), a host, no credentials, and no literal address that isn't public."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").encode("idna").decode()
        if parts.scheme not in ("http", "https") or not host or parts.username is not None or parts.password is not None or parts.port == 0:
            return False
    except (ValueError, UnicodeError):
        return False
    if host == "localhost" or host.endswith(".localhost"):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


def allowed(url: Column | str) -> Column:
    def check(urls: pd.Series) -> pd.Series:
        return urls.map(url_allowed)

    return F.pandas_udf(check, "boolean")(url)


def catalogs(spark: SparkSession, path: str) -> DataFrame:
    """A row a feed of JSON catalogs: catalog -> groups -> entries -> feeds, with defaults that
    cascade from catalog to entry to feed."""
    feed = "struct<name:string,url:string,active:boolean,priority:int>"
    entry = f"struct<name:string,source_type:string,country:string,feeds:array<{feed}>>"
    schema = f"catalog string, country string, source_type string, groups array<struct<name:string,entries:array<{entry}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = rows.select("catalog", "country", "source_type", F.explode("groups").alias("g")).select("catalog", "country", "source_type", F.col("g.name").alias("group"), F.explode("g.entries").alias("e"))
    rows = rows.select("catalog", "group", F.col("e.name").alias("name"), F.coalesce("e.source_type", "source_type").alias("source_type"), F.coalesce("e.country", "country").alias("country"), F.posexplode_outer("e.feeds").alias("place", "f"))
    return rows.select("catalog", "group", "name", "source_type", "country", (F.col("place") == 0).alias("is_primary"), F.col("f.name").alias("feed_name"), F.col("f.url").alias("url"), F.coalesce("f.active", F.lit(True)).alias("active"), F.coalesce("f.priority", F.lit(0)).alias("priority"))


def catalog_violations(rows: DataFrame) -> DataFrame:
    """(rule, name): what breaks a rule of the catalog, one query a rule."""
    from newsprism.sources.model import SOURCE_TYPES

    rules = {
        "source_type": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
        "country": F.col("country").isNotNull() & ~F.col("country").rlike("^[A-Z]{2}$"),
        "blank_name": F.trim(F.coalesce("name", F.lit(""))) == "",
        "url": F.col("url").isNotNull() & ~F.col("url").rlike("^https?://[^/]+"),
    }
    found = None
    for rule, broken in rules.items():
        own = rows.where(broken).select(F.lit(rule).alias("rule"), "name")
        found = own if found is None else found.union(own)
    shared = rows.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).where("n > 1")
    twice = rows.join(shared, "url").select(F.lit("unique_url").alias("rule"), "name")
    return found.union(twice)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
