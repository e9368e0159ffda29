"""URL allow and block lists in one trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import free_names

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased.

    Empty for a null url and for one without ``://``.
    """
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; may be empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleTrie:
    """Longest match among rules (verdict, host, path).

    A host's labels from the right lead to a node; below it the path's segments,
    each with its closing slash, lead on.  The last segment of a rule may be
    unfinished (``/en/1``): it is kept as a stub and fits any segment that
    begins with it.  More host labels win over fewer, then the longer path; of
    two rules for the same place the later one wins.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, stub = path.split("/")
            for part in whole:
                node = node.setdefault(("path", part), {})
            node.setdefault("stubs", {})[stub] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        parts = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._below(node, parts) or best
        return best

    @staticmethod
    def _below(node: dict, parts: list[str]) -> tuple[str, str] | None:
        best = None
        for k, part in enumerate(parts):
            stubs = node.get("stubs")
            if stubs:
                fit = [s for s in stubs if part.startswith(s)]
                if fit:
                    best = stubs[max(fit, key=len)]
            if k == len(parts) - 1:
                break
            node = node.get(("path", part))
            if node is None:
                break
        return best


def filter_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    default: str = "allow",
    max_rules: int = 1_000_000,
) -> DataFrame:
    """``pages`` with columns host, path, rule and verdict (replaced if there).

    ``rules`` are (verdict, host, path); a rule fits its host and all its
    subdomains where the path begins with its own.  A url that no rule fits has
    a null rule and ``default`` as its verdict; so have null urls and those
    without a host.  The trie goes to every task as a broadcast value and is
    refused above ``max_rules`` rules.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules are more than max_rules={max_rules}")
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, decided string")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for hosts, paths in parts:
            found = [find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            yield pd.DataFrame({"rule": [r for _, r in found], "decided": [v for v, _ in found]}, dtype=object)

    pages = pages.drop("host", "path", "rule", "verdict")
    (found,) = free_names(pages, "_match")
    return (
        pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
        .withColumn(found, match("host", "path"))
        .withColumn("rule", F.col(found)["rule"])
        .withColumn("verdict", F.coalesce(F.col(found)["decided"], F.lit(default)))
        .drop(found)
    )


URL_SQL = r"""
WITH part AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path
           ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS n
  FROM part p LEFT JOIN rules r
    ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE n = 1
"""
