"""URL filter: a weighted vocabulary counted by one Aho-Corasick automaton.

A term counts where it stands in the lower-cased URL with no ASCII letter or digit
just before or after it.  One strict term rejects; soft terms reject when
``soft_limit`` different ones occur.  ``score`` adds the weights of all counted
occurrences.

Cases: a null or empty URL has no hits, score 0 and is kept; URLs are read whole
whatever their length; repeated rows and ids stay separate rows; ids may be numbers or
texts; overlapping terms all count; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

STRICT = {"porn": 10, "porno": 10, "xxx": 10, "xxxvideos": 10, "hentai": 10, "escort": 8, "escorts": 8, "milf": 10, "camgirls": 10, "nudes": 8, "spam-farm": 10, "link-farm": 10, "warez": 9, "keygen": 9, "phishing": 9, "malware": 9, "viagra": 9, "cialis": 9}
SOFT = {"casino": 4, "poker": 3, "slots": 3, "roulette": 3, "betting": 3, "bet": 2, "jackpot": 2, "win": 1, "winner": 1, "bonus": 1, "free": 1, "cheap": 1, "deal": 1, "deals": 1, "adult": 3, "sex": 3, "sexy": 3, "dating": 2, "loan": 2, "loans": 2, "payday": 3, "crypto": 1, "pills": 3, "replica": 2, "torrent": 2, "cracked": 2, "click": 1, "promo": 1, "download": 1}
SOFT_LIMIT = 2
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "strict_hits long, soft_hits long, soft_distinct long, score long, rejected boolean"


def automaton(strict: dict[str, int], soft: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for terms, is_strict in ((soft, False), (strict, True)):  # a term of both is strict
        for term, weight in terms.items():
            found.add_word(term, (term, weight, is_strict))
    found.make_automaton()
    return found


def count(url: str | None, found: ahocorasick.Automaton, soft_limit: int) -> tuple[int, int, int, int, bool]:
    strict = soft = score = 0
    distinct = set()
    if url and len(found):
        low = url.lower()
        last = len(low) - 1
        for end, (term, weight, is_strict) in found.iter(low):
            start = end - len(term) + 1
            if (start and low[start - 1] in _WORD) or (end < last and low[end + 1] in _WORD):
                continue
            score += weight
            if is_strict:
                strict += 1
            else:
                soft += 1
                distinct.add(term)
    return strict, soft, len(distinct), score, bool(strict or len(distinct) >= soft_limit)


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", strict: dict[str, int] = STRICT, soft: dict[str, int] = SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``page_id, strict_hits, soft_hits, soft_distinct, score, rejected`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = automaton(strict, soft)
        for pdf in batches:
            rows = [count(u if isinstance(u, str) else None, found, soft_limit) for u in pdf["url"]]
            out = pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "soft_distinct", "score", "rejected"]).astype({"strict_hits": "int64", "soft_hits": "int64", "soft_distinct": "int64", "score": "int64", "rejected": "bool"})
            out.insert(0, "page_id", pdf["page_id"].to_numpy())
            yield out

    kind = id_type(pages, id_col)
    return pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).cast("string").alias("url")).mapInPandas(run, f"page_id string, {SCHEMA}").withColumn("page_id", F.col("page_id").cast(kind))


def sql() -> str:
    """The same over ``pages``: each character that isn't of a word is doubled, so that
    neighbouring terms don't share their boundary."""
    double = lambda x: "".join(c if c in _WORD else c * 2 for c in x)
    rows = [f"('{t}', '{double(t)}', {w}, {strict})" for terms, strict in ((STRICT, "true"), (SOFT, "false")) for t, w in terms.items()]
    return f"""
WITH terms(term, pattern, weight, strict) AS (VALUES {", ".join(rows)}),
p AS (SELECT row_number() OVER () AS r, page_id, '//' || regexp_replace(lower(coalesce(url, '')), '([^a-z0-9])', '\\1\\1', 'g') || '//' AS u FROM pages),
hits AS (SELECT r, term, weight, strict, len(regexp_extract_all(u, '[^a-z0-9]' || pattern || '[^a-z0-9]')) AS n
         FROM p, terms WHERE contains(u, pattern))
SELECT p.page_id,
       coalesce(sum(n) FILTER (WHERE strict), 0)::BIGINT AS strict_hits,
       coalesce(sum(n) FILTER (WHERE NOT strict), 0)::BIGINT AS soft_hits,
       (count(*) FILTER (WHERE NOT strict AND n > 0))::BIGINT AS soft_distinct,
       coalesce(sum(n * weight), 0)::BIGINT AS score,
       coalesce(sum(n) FILTER (WHERE strict), 0) > 0 OR count(*) FILTER (WHERE NOT strict AND n > 0) >= {SOFT_LIMIT} AS rejected
FROM p LEFT JOIN hits ON hits.r = p.r GROUP BY p.r, p.page_id"""
