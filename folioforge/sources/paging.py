"""Paged sources: answers of many endpoints read page after page, one round of requests at a time.

A round is a DataFrame of the requests that are due, whatever number of endpoints they belong to; ``fetch`` turns it into
answers (over HTTP in the tasks, or by a join with stored answers).  Each round's answers are written before the next one
is made of them, so that a lost executor repeats at most its own requests of one round.
"""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise
from folioforge.sources import records

#: No endpoint is asked for more pages in a call, and no answer may be longer.
MOST_PAGES, MOST_BYTES = 10, 5_000_000
_ANSWERS = "key string, url string, token string, total bigint, body string, link string"


class _Stay(urllib.request.HTTPRedirectHandler):
    """Redirects aren't followed: they could leave the endpoint's host."""

    def redirect_request(self, *args):
        return None


def over_http(param: str | None = None, size_param: str | None = None, size: int | None = None, headers: dict | None = None, timeout: float = 20.0, most_bytes: int = MOST_BYTES) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` that asks by HTTP in the tasks: the token goes into the query string as ``param``; without one it is the URL itself.

    Failures and answers that aren't UTF-8 give a null body; one byte more than ``most_bytes`` is read, so that the call sees what is too large.
    """

    def ask(url: str, token: str | None) -> tuple[str | None, str | None]:
        if param is None:
            target = token or url
        else:
            extra = {size_param: size} if size_param and size else {}
            extra |= {param: token} if token else {}
            target = url + (("&" if "?" in url else "?") + urllib.parse.urlencode(extra) if extra else "")
        if not target.lower().startswith(("http://", "https://")):
            return None, None
        try:
            request = urllib.request.Request(target, headers=headers or {})
            with urllib.request.build_opener(_Stay).open(request, timeout=timeout) as answer:
                link = next((part.split(";")[0].strip(" <>") for part in (answer.headers.get("Link") or "").split(",") if 'rel="next"' in part), None)
                return answer.read(most_bytes + 1).decode("utf-8"), link
        except (OSError, ValueError):
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = [ask(u, t if isinstance(t, str) else None) for u, t in zip(batch["url"], batch["token"])]
            yield batch[["key", "url", "token", "total"]].assign(body=[b for b, _ in got], link=[n for _, n in got])

    return lambda due: due.mapInPandas(run, _ANSWERS)


def stored(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A ``fetch`` from answers held in a table (key, token, body, link); a token is null-safe equal to its answer's."""
    held = answers.select(F.col("key").alias("_k"), F.col("token").alias("_t"), "body", "link")
    return lambda due: due.join(held, (F.col("key") == F.col("_k")) & F.col("token").eqNullSafe(F.col("_t")), "left").select("key", "url", "token", "total", "body", "link")


def _joined(base: Column, link: Column) -> Column:
    """A link as seen from a URL: absolute, from the host's root, a new query, or beside the last step."""
    origin, bare = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), F.regexp_replace(base, r"[?#].*$", "")
    beside = F.concat(F.when(bare == origin, F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", "")), link)
    return F.when(link.rlike("^[A-Za-z]+://"), link).when(link.startswith("/"), F.concat(origin, link)).when(link.startswith("?"), F.concat(bare, link)).otherwise(beside)


def calls(endpoints: DataFrame, fetch: Callable[[DataFrame], DataFrame], style: str, rows_path: str, limit: int = 50, pages: int = MOST_PAGES, first: int = 1, size: int | None = None, cursor_path: str = "", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, page, token, body, n, error): the answers of each endpoint (key, url) in the order asked for.

    ``style``: ``none`` asks once; ``page`` counts up from ``first``; ``offset`` steps by ``size``, or by the rows had so far;
    ``cursor`` asks for what the answer names at ``cursor_path``; ``link`` follows the answer's link to its next page, on the same host only.
    An endpoint ends when ``limit`` rows are had, at its last page (no row, fewer than ``size``, no cursor or link), or
    after ``pages``, ten at most.  ``error``: ``no answer``, ``too large`` or ``off host``; such an endpoint ends, its earlier pages stay.
    """
    if style not in ("none", "page", "offset", "cursor", "link"):
        raise ValueError(f"no such style of pages: {style}")
    start = {"page": F.lit(str(first)), "offset": F.lit(str(first)), "link": F.col("url")}.get(style, F.lit(None).cast("string"))
    due = endpoints.select(F.col("key").cast("string").alias("key"), "url", start.alias("token"), F.lit(0).cast("bigint").alias("total"))
    host = lambda u: F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
    rounds = []
    for i in range(1 if style == "none" else max(1, min(pages, MOST_PAGES))):
        got = fetch(due).withColumn("page", F.lit(i + 1))
        wrong = F.when(F.col("body").isNull(), "no answer").when(F.octet_length("body") > most_bytes, "too large")
        found = records.dig(F.col("body"), rows_path)
        n = F.when(wrong.isNotNull() | found.isNull(), 0).otherwise(F.coalesce(F.json_array_length(found), F.lit(1)))
        after = _joined(F.col("token"), F.col("link")) if style == "link" else F.lit(None).cast("string")
        strayed = F.coalesce(host(after) != host(F.col("url")), F.lit(False))
        got = got.withColumns({"n": n, "after": after}).withColumn("error", F.coalesce(wrong, F.when(strayed, "off host")))
        got = materialise(got.withColumn("total", F.col("total") + F.col("n")), "pages")
        rounds.append(got.select("key", "page", "token", "body", "n", "error"))
        if style in ("page", "offset"):
            step = F.lit(i + 1) if style == "page" else F.lit((i + 1) * size) if size else F.greatest("total", F.lit(1))
            token = F.when(F.col("n") >= (size or 1), (F.lit(first) + step).cast("string"))
        elif style == "cursor":
            token = F.nullif(F.nullif(records.dig(F.col("body"), cursor_path), F.lit("")), F.lit("[]"))
        else:
            token = F.col("after")
        due = got.where(F.col("error").isNull() & (F.col("total") < limit)).select("key", "url", token.alias("token"), "total").where("token is not null")
        if due.isEmpty():
            break
    return reduce(DataFrame.unionByName, rounds)


def rows(answers: DataFrame, rows_path: str) -> DataFrame:
    """(key, page, row): the rows of the answers without an error, as JSON; nothing is cut to the call's limit."""
    return records.json_rows(answers.where("error is null or error = 'off host'"), "body", rows_path).select("key", "page", "row")
