"""Drafts of connectors: operations that read, from OpenAPI documents and from curl commands, a DataFrame of either at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of parameters and headers that carry credentials, which no draft holds.
SECRET = r"(?i)api[-_]?key|token|secret|access_key"
NAME_CHARS = 40
_PARAMS = "array<struct<name: string, key: string, place: string, type: string, required: boolean, default: string>>"
_SPEC = "struct<servers: array<struct<url: string>>, schemes: array<string>, host: string, basePath: string, paths: map<string, map<string, string>>>"
_PARAMETER = "array<struct<name: string, `in`: string, required: boolean, type: string, schema: struct<type: string, default: string>>>"
_OPERATION = f"struct<operationId: string, summary: string, parameters: {_PARAMETER}>"


def slug(text: Column) -> Column:
    """Lower-case letters and digits, other runs as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def parameter_name(key: Column) -> Column:
    """A key as a name: word characters, 40 at most, not beginning with a digit."""
    name = F.substring(F.regexp_replace(key, r"[^A-Za-z0-9_]", "_"), 1, NAME_CHARS)
    return F.when(name == "", "param").when(name.rlike("^[0-9]"), F.concat(F.lit("p_"), name)).otherwise(name)


def _kind(given: Column) -> Column:
    """A schema's type as a draft's: int, number, boolean, else string."""
    return F.when(given == "integer", "int").when(given.isin("number", "boolean"), given).otherwise("string")


def from_openapi(specs: DataFrame, key: str, spec: str) -> DataFrame:
    """(key, base_url, id, method, path, params, summary): the GET and POST operations of OpenAPI 3 and Swagger 2 documents as JSON.

    Parameters of a path count for its operations, an operation's own go before those of one name; only those in the query and the
    path are kept, without credentials and without references.  Texts that aren't JSON, and documents without paths, give no row.
    """
    read = specs.select(F.col(key), F.from_json(spec, _SPEC).alias("s")).where("s.paths is not null")
    swagger = F.concat(F.coalesce(F.get("s.schemes", F.lit(0)), F.lit("https")), F.lit("://"), F.col("s.host"), F.coalesce("s.basePath", F.lit("")))
    base = F.regexp_replace(F.coalesce(F.get("s.servers", F.lit(0))["url"], swagger, F.lit("")), "/+$", "")
    paths = read.select(key, base.alias("base_url"), F.explode("s.paths").alias("path", "_item"))
    common = F.from_json(F.try_element_at("_item", F.lit("parameters")), _PARAMETER)
    each = paths.select(key, "base_url", "path", common.alias("_common"), F.explode("_item").alias("_verb", "_op")).where(F.lower("_verb").isin("get", "post"))
    each = each.withColumn("_o", F.from_json("_op", _OPERATION)).where("_o is not null")
    none = F.array().cast(_PARAMETER)
    own = F.coalesce("_o.parameters", none)
    all_ = F.concat(own, F.filter(F.coalesce("_common", none), lambda p: ~F.exists(own, lambda q: q["name"].eqNullSafe(p["name"]) & q["in"].eqNullSafe(p["in"]))))
    kept = F.filter(all_, lambda p: p["name"].isNotNull() & p["in"].isin("query", "path") & ~p["name"].rlike(SECRET))
    draft = lambda p: F.struct(
        parameter_name(p["name"]).alias("name"), p["name"].alias("key"), p["in"].alias("place"), _kind(F.coalesce(p["schema"]["type"], p["type"])).alias("type"),
        (F.coalesce(p["required"], F.lit(False)) | (p["in"] == "path")).alias("required"), p["schema"]["default"].alias("default"),
    )
    named = F.coalesce(F.nullif(slug(F.col("_o.operationId")), F.lit("")), slug(F.concat_ws("_", "_verb", "path")))
    return each.select(key, "base_url", named.alias("id"), F.upper("_verb").alias("method"), "path", F.transform(kept, draft).cast(_PARAMS).alias("params"), F.col("_o.summary").alias("summary"))


def from_curl(commands: DataFrame, key: str, command: str) -> DataFrame:
    """(key, base_url, id, method, path, params, auth, refused): the one operation of each curl command.

    Values of its query become parameters with these as defaults; credentials are left out, and ``auth`` says which kind there was
    (basic, bearer, header, query, none).  ``refused``: ``not curl``, ``no address``, or ``changes data`` for methods other than GET and POST.
    """
    pieces = F.regexp_extract_all(F.regexp_replace(F.coalesce(command, F.lit("")), r"\\\r?\n", " "), F.lit(r"""(?:[^\s'"]|'[^']*'|"[^"]*")+"""), F.lit(0))
    words = F.transform(pieces, lambda w: F.regexp_replace(w, r"""'([^']*)'|"([^"]*)\"""", "$1$2"))
    rows = commands.select(F.col(key), words.alias("_w")).withColumn("_p", F.transform("_w", lambda w, i: F.struct(w.alias("w"), F.when(i > 0, F.get("_w", i - 1)).otherwise("").alias("after"))))
    after = lambda *flags: F.transform(F.filter("_p", lambda p: p["after"].isin(*flags)), lambda p: p["w"])
    data = ("-d", "--data", "--data-raw", "--data-binary", "--json")
    valued = ("-X", "--request", "-H", "--header", "-u", "--user", *data)
    address = F.get(F.filter("_p", lambda p: p["w"].rlike("^https?://") & ~p["after"].isin(*valued)), F.lit(0))["w"]
    rows = rows.withColumns({"_url": F.regexp_replace(address, "#.*$", ""), "_heads": after("-H", "--header"), "_user": F.size(after("-u", "--user")) > 0})
    asked = F.upper(F.element_at(F.concat(F.array(F.when(F.size(after(*data)) > 0, "POST").otherwise("GET")), after("-X", "--request")), -1))
    query = F.filter(F.split(F.regexp_extract("_url", r"\?(.*)$", 1), "&"), lambda x: x != "")
    text = lambda x: F.coalesce(F.try_url_decode(x), x)
    pairs = F.transform(query, lambda x: F.struct(text(F.substring_index(x, "=", 1)).alias("k"), text(F.regexp_replace(x, "^[^=]*=?", "")).alias("v")))
    whole = lambda v: v.rlike("^[0-9]+$")
    params = F.transform(F.filter(pairs, lambda p: ~p["k"].rlike(SECRET)), lambda p: F.struct(
        parameter_name(p["k"]).alias("name"), p["k"].alias("key"), F.lit("query").alias("place"), F.when(whole(p["v"]), "int").otherwise("string").alias("type"), F.lit(False).alias("required"), p["v"].alias("default"),
    ))
    heads = F.col("_heads")
    auth = (
        F.when(F.exists(pairs, lambda p: p["k"].rlike(SECRET)), "query").when(F.col("_user"), "basic").when(F.exists(heads, lambda h: h.rlike(r"(?i)^\s*authorization\s*:\s*bearer\b")), "bearer")
        .when(F.exists(heads, lambda h: F.substring_index(h, ":", 1).rlike("(?i)^\\s*authorization\\s*$|api[-_]?key|token|secret")), "header").otherwise("none")
    )
    refused = F.when(F.coalesce(F.get("_w", F.lit(0)), F.lit("")) != "curl", "not curl").when(F.col("_url").isNull(), "no address").when(~asked.isin("GET", "POST"), "changes data")
    base, path = F.regexp_extract("_url", "^https?://[^/?]*", 0), F.regexp_extract("_url", "^https?://[^/?]*([^?]*)", 1)
    last = slug(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0))
    made = {"base_url": base, "id": F.coalesce(F.nullif(last, F.lit("")), F.lit("query")), "method": asked, "path": F.coalesce(F.nullif(path, F.lit("")), F.lit("/")), "params": params.cast(_PARAMS), "auth": auth}
    return rows.select(key, *[F.when(refused.isNull(), c).alias(n) for n, c in made.items()], refused.alias("refused"))
