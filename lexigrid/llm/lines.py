"""Line dedup by site-relative frequency.

Pages are grouped by host.  For each line the pages of the host that contain
it are counted and divided by all pages of the host; lines whose ratio exceeds
a limit are boilerplate and are dropped from every page of that host.

Lines travel as 128-bit keys, once for each page, so the shuffle holds no text
and a hot host is spread over its lines.  Against a host's short list of
boilerplate the first half of a key tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Highest share of a host's pages that a line may be in; fewest pages that make a line boilerplate (on one page it is no repetition).
RATIO, LEAST_PAGES = 0.1, 2
TAGS = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>"


def html_lines(html: Column) -> Column:
    """The pieces of text between tags, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(html, TAGS), lambda x: F.trim(x)), lambda x: x != "")


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


#: Scheme and user before a host, if any; the host, with its port, is a name with a dot or what follows ``//``.
HOST = r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#@]+)|([a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+(?::[0-9]+)?)(?:[/?#].*)?$)"


def url_host(url: Column) -> Column:
    """The host of an address in lower case, also of one without a scheme (``example.com/a``); null if there is none."""
    found = F.concat(F.regexp_extract(url, HOST, 1), F.regexp_extract(url, HOST, 2))
    return F.when(found != "", F.lower(found))


def _key(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))


def clean(pages: DataFrame, lines: Column, host: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """All columns of ``pages``, with ``lines`` (an array), ``kept`` (its lines that aren't boilerplate, in order, repeated ones too) and ``n_dropped``.

    A line is boilerplate if it is on at least ``least_pages`` pages of its
    host and on more than ``ratio`` of them; one that is exactly at the ratio
    stays.  Rows with a null host form no site: their lines all stay.  A null
    text has no lines, and its row stays with null ``kept`` and 0 dropped, but
    counts as a page of its host.  Each repeated row counts as a page.  Of
    input columns named ``kept`` or ``n_dropped`` the new ones take the place.
    """
    h, ls, keys = (C.fresh(pages, n) for n in ("host", "lines", "keys"))
    base = pages.withColumn(h, host).withColumn(ls, lines)
    slim = pages.select(host.alias("host"), F.array_distinct(F.transform(lines, _key)).alias("keys")).where("host is not null")
    total = slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = slim.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    over = seen.join(total, "host").where(F.col("n") > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.collect_list("key.a").alias("drop"))
    over = C.materialize(over, "boilerplate")
    # A host drops at most lines-a-page / ratio lines, so its list is short whatever its pages.
    bytes_ = over.agg(F.sum(F.size("drop") * 16 + 64)).first()[0] or 0
    side = over.select(F.col("host").alias(h), F.col("drop").alias(keys))
    side = F.broadcast(side) if bytes_ <= C.BROADCAST_BYTES else side
    out = base.join(side, h, "left")
    # A page's own boilerplate first, by hashing; its lines are then held against these few only.
    own = F.array_intersect(F.transform(F.col(ls), lambda x: F.xxhash64(x)), F.col(keys))
    out = out.withColumn(keys, F.when(F.col(keys).isNotNull(), own))
    kept = F.when(F.coalesce(F.size(F.col(keys)), F.lit(0)) <= 0, F.col(ls)).otherwise(F.filter(F.col(ls), lambda x: ~F.array_contains(F.col(keys), F.xxhash64(x))))
    out = out.withColumn("kept", kept).withColumn("n_dropped", F.coalesce(F.size(F.col(ls)) - F.size("kept"), F.lit(0)))
    return out.select(*[c for c in pages.columns if c not in ("kept", "n_dropped")], "kept", "n_dropped")


ORACLE = rf"""
WITH p AS (
  SELECT page_id, lower(nullif(regexp_extract(url, '{HOST}', 1) || regexp_extract(url, '{HOST}', 2), '')) AS host,
         list_filter(list_transform(regexp_split_to_array(html, '{TAGS}'), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), total AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
over AS (
  SELECT host, list(line) AS dropped FROM seen JOIN total USING (host) WHERE n >= {LEAST_PAGES} AND n > {RATIO} * pages GROUP BY host
)
SELECT page_id, array_to_string(list_filter(lines, lambda x: dropped IS NULL OR NOT list_contains(dropped, x)), chr(10)) AS kept_text,
       len(list_filter(lines, lambda x: dropped IS NOT NULL AND list_contains(dropped, x)))::INT AS n_dropped
FROM p LEFT JOIN over USING (host)
"""
