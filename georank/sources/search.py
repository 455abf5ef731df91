"""Scene catalogs over HTTP: each search is a partition of a Python data source that follows its pages."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import urlencode, urljoin, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from georank.recipe import Recipe
from georank.shipping import ship
from georank.sources.catalog import items_of

#: Items of a page at most.
PAGE_ITEMS = 500


def send(method: str, url: str, body: dict | None, headers: dict[str, str], timeout: float) -> dict:
    """One request's JSON answer; a GET carries its body as a query string. Only http and https; an error status raises."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise ValueError(f"no http address: {url}")
    data = None
    if body and method == "GET":
        url += ("&" if "?" in url else "?") + urlencode({k: json.dumps(v) if isinstance(v, dict) else v for k, v in body.items()}, doseq=True)
    elif method != "GET":
        data = json.dumps(body or {}).encode()
    asked = Request(url, data, {"Accept": "application/json", "Content-Type": "application/json"} | headers, method=method)
    with urlopen(asked, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


def follow(url: str, query: dict, max_pages: int, ask: Callable[[str, str, dict | None, dict], dict]) -> Iterator[dict]:
    """The pages of a search, at most max_pages: a POST of the query, then each page's first link to a next page not yet followed."""
    step, followed = ("POST", url, query, {}), set()
    for _ in range(max_pages):
        page = ask(*step)
        yield page
        for link in page.get("links") or []:
            if link.get("rel") != "next" or not link.get("href"):
                continue
            key = (str(link.get("method") or "GET").upper(), urljoin(step[1], link["href"]))
            if key not in followed:
                followed.add(key)
                step = (*key, link.get("body"), link.get("headers") or {})
                break
        else:
            return


class SearchSource(DataSource):
    """Pages as (value, file, line): option ``searches`` lists {url, query, headers, timeout_s, max_pages} as JSON."""

    @classmethod
    def name(cls) -> str:
        return "georank_search"

    def schema(self) -> str:
        return "value string, file string, line bigint"

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(json.loads(self.options["searches"]))


class SearchReader(DataSourceReader):
    def __init__(self, searches: list[dict]):
        self.searches = searches

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in range(len(self.searches))]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, int]]:
        if partition is None or partition.value is None:  # no searches
            return
        s = self.searches[partition.value]
        ask = lambda method, url, body, headers: send(method, url, body, s["headers"] | headers, s["timeout_s"])
        for k, page in enumerate(follow(s["url"], s["query"], s["max_pages"], ask)):
            yield json.dumps({"features": page.get("features") or []}), f"{partition.value:06d}", k


def search_items(spark: SparkSession, recipe: Recipe, rings: list[list[tuple[float, float]]]) -> DataFrame:
    """Items, as catalog.read_items gives them, of one search for each enabled series: its collection and time within the outer rings.

    Each search is a task of its own, and a lost one starts again. Items that several searches find count once.
    """
    ship(spark)
    closed = [[list(p[:2]) for p in (r if tuple(r[0]) == tuple(r[-1]) else [*r, r[0]])] for r in rings]
    shape = {"type": "Polygon", "coordinates": closed} if len(closed) == 1 else {"type": "MultiPolygon", "coordinates": [[r] for r in closed]}
    client, searches = recipe.stac, []
    for series in recipe.series.values():
        if series.enabled:
            query = {"collections": [series.collection], "intersects": shape, "limit": max(1, min(series.search_limit, PAGE_ITEMS))}
            query |= {"datetime": series.datetime} if series.datetime else {}
            searches.append({"url": client.endpoint.rstrip("/") + "/search", "query": query, "headers": client.headers, "timeout_s": client.timeout_s, "max_pages": client.max_pages})
    spark.dataSource.register(SearchSource)
    return items_of(spark.read.format("georank_search").option("searches", json.dumps(searches)).load())
