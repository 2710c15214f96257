"""Language ID by Bayesian evidence fusion.

For each row the posterior of a language is proportional to

    P(text | l) * P(declared | l) * P(suffix | l) * P(l | host)

* text: byte trigrams, hashed to 2^15 places, under a multinomial model with additive smoothing. A text's
  log-likelihood is brought to at most ``strength`` trigrams' worth, for trigrams aren't independent.
* declared language (a ``lang`` attribute or column) and address suffix (a path part or top-level domain that
  names a language): how often each value goes with each language, by grouped aggregation over all rows,
  with additive smoothing; a missing value says nothing.
* host: counts by host, by the site it belongs to, and of all rows, each smoothed by the level above,
  P(l | host) = (n(host, l) + k * P(l | site)) / (n(host) + k), and so on up to the uniform distribution. The
  counts are those of the text's likeliest language. They are joined, not collected, and carry hosts, not rows.

The languages are all that any row with a text declares. The text model learns from a bounded number of rows of each
(lowest id hash; ``train_rows`` shared out evenly, 100 to 1,000 a language) and the first ``train_chars`` characters of
their texts; everything else covers all rows and whole texts.

A row is rejected if its text has no letters, if its best posterior is below ``sure``, or if no language fits: equally
likely trigrams explain the text better than the likeliest language does, as for texts in a language nobody declares.

Defined cases: null and empty texts have a flat likelihood (other evidence decides) and are rejected; without
any declared language there is the one language ``und``; ``en-us`` declares ``en``, what isn't such a code declares nothing;
ties go to the first code; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mendwright.llm.common import blocks, looked_up, written

PLACES = 1 << 15
#: Log probability of a trigram if all places are equally likely, less what 32-bit numbers may err.
UNIFORM = -np.log(PLACES) - 1e-3
LETTER = re.compile(r"[^\W\d_]")
#: A language's code; regions and scripts after it don't count, other values say nothing.
LANGUAGE_CODE = r"^([a-z]{2,3})(?:[-_].*)?$"
#: Country domains by the language that they mostly stand for.
DOMAIN_LANGUAGE = {"at": "de", "br": "pt", "de": "de", "es": "es", "fr": "fr", "it": "it", "mx": "es", "nl": "nl", "pt": "pt", "uk": "en", "us": "en"}


def trigram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-cased text, spaces around it."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(PLACES)
    code = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(17), minlength=PLACES)


class TextModel:
    """Log probabilities of trigram places for each language."""

    def __init__(self, languages: list[str], log_p: np.ndarray) -> None:
        self.languages, self.log_p = languages, log_p

    @classmethod
    def of_counts(cls, sums: dict[str, np.ndarray]) -> TextModel:
        languages = sorted(sums) or ["und"]
        counts = np.array([sums.get(x, np.zeros(PLACES)) for x in languages]) + 0.1
        return cls(languages, np.log(counts / counts.sum(1, keepdims=True)).T.astype(np.float32))

    def read(self, text: str, strength: float) -> tuple[np.ndarray, bool]:
        """Log-likelihood of each language, and whether the likeliest explains the text as well as equally likely trigrams."""
        c = trigram_counts(text) if text else np.zeros(PLACES)
        at = np.flatnonzero(c)
        n = c.sum()
        if not n:
            return np.zeros(len(self.languages)), True
        ll = c[at] @ self.log_p[at]
        return ll * (min(n, strength) / n), bool(ll.max() / n >= UNIFORM)


def fit(rows: DataFrame, train_rows: int = 1500, train_chars: int = 30_000) -> TextModel:
    """rows: (id, text, declared)."""
    own = rows.where(F.col("declared").isNotNull() & (F.length("text") > 0)).select("id", "declared", F.substring("text", 1, train_chars).alias("text"))
    languages = own.select("declared").distinct().count()
    each = min(max(-(-train_rows // max(1, languages)), 100), 1000)  # up to 1,000 the ranks are cut before the shuffle

    def lowest(df: DataFrame, *then: str) -> DataFrame:
        order = Window.partitionBy("declared").orderBy(F.xxhash64("id"), "id", *then)
        return df.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).drop("k")

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PLACES)
        for text in frame["text"]:
            total += np.minimum(trigram_counts(text), 50)
        return pd.DataFrame({"declared": frame["declared"].iloc[:1], "sums": [total.astype("<f8").tobytes()]})

    # ids first, so that the sort carries no texts
    picked = lowest(own.select("id", "declared")).distinct().select(F.col("id").alias("i"), F.col("declared").alias("d"))
    texts = own.join(F.broadcast(picked), F.col("id").eqNullSafe(F.col("i")) & (F.col("declared") == F.col("d")), "left_semi")
    sums = lowest(texts, "text").groupBy("declared").applyInPandas(summed, "declared string, sums binary").collect()
    return TextModel.of_counts({r["declared"]: np.frombuffer(r["sums"], "<f8") for r in sums})


def _smoothed(counts: DataFrame, keys: list[str], above: Column | None, table: DataFrame | None, k: float) -> DataFrame:
    """P(l | keys) as arrays ``p``: the level's count arrays ``c`` smoothed by ``above``, the level above, which may come from ``table``."""
    if table is not None:
        counts = counts.join(table.withColumnRenamed("p", "q"), "site")
    else:
        counts = counts.withColumn("q", above)
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    return counts.withColumn("p", F.transform(F.arrays_zip("c", "q"), lambda z: (z["c"] + k * z["q"]) / (total + k))).select(*keys, "p")


def identify(df: DataFrame, id_col: str, text_col: str, declared: Column, host: Column, site: Column, suffix: Column, strength: float = 60.0, sure: float = 0.5, host_weight: float = 20.0) -> DataFrame:
    """One row per row of ``df``: id, language, posterior, text_language, declared, rejected."""
    rows = df.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.nullif(F.regexp_extract(F.lower(F.trim(declared)), LANGUAGE_CODE, 1), F.lit("")).alias("declared"),
        F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.nullif(F.lower(suffix), F.lit("")).alias("suffix"),
    )
    model = fit(rows)
    langs, n = model.languages, len(model.languages)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in blocks(frames):
            found = [model.read(t, strength) for t in frame["text"]]
            yield frame.drop(columns="text").assign(ll=[x for x, _ in found], best=[int(np.argmax(x)) for x, _ in found], letters=[LETTER.search(t) is not None for t in frame["text"]], fits=[f for _, f in found])

    kind = rows.schema["id"].dataType.simpleString()
    told = written(rows.mapInPandas(work, f"id {kind}, declared string, host string, site string, suffix string, ll array<double>, best int, letters boolean, fits boolean"))
    counted = F.array(*[F.count_if((F.col("best") == k) & F.col("letters")).cast("double") for k in range(n)]).alias("c")
    overall = told.agg(counted).first()["c"]  # a number for each language
    everywhere = F.array(*[F.lit((c + 1.0 / n) / (sum(overall) + 1.0)) for c in overall])
    by_site = _smoothed(told.groupBy("site").agg(counted), ["site"], everywhere, None, host_weight)
    by_host = _smoothed(told.groupBy("host", "site").agg(counted), ["host", "site"], None, by_site, host_weight)

    def given(column: str) -> DataFrame:
        """log P(value | l) of the values of a column, as arrays ``e_<column>``."""
        each = told.where(F.col(column).isNotNull()).groupBy(column).agg(counted)
        total = each.agg(*[F.coalesce(F.sum(F.col("c")[k]), F.lit(0.0)) for k in range(n)], F.count("*")).first()
        logs = [F.ln((F.col("c")[k] + 0.5) / (total[k] + 0.5 * (total[n] + 1))) for k in range(n)]
        return each.select(column, F.array(*logs).alias(f"e_{column}"))

    zeros = F.array(*[F.lit(0.0)] * n)
    fused = looked_up(told, by_host, ["host", "site"]).join(given("declared"), "declared", "left").join(given("suffix"), "suffix", "left")
    fused = fused.withColumns({"lp": F.transform("p", lambda x: F.ln(x)), "ed": F.coalesce("e_declared", zeros), "es": F.coalesce("e_suffix", zeros)})
    log_post = F.transform(F.arrays_zip("ll", "lp", "ed", "es"), lambda z: z["ll"] + z["lp"] + z["ed"] + z["es"])
    fused = fused.withColumn("post", log_post).withColumn("high", F.array_max("post"))
    names = F.array(*[F.lit(x) for x in langs])
    posterior = 1 / F.aggregate(F.col("post"), F.lit(0.0), lambda a, x: a + F.exp(x - F.col("high")))
    return fused.select(
        F.col("id").alias(id_col), F.element_at(names, F.array_position("post", F.col("high")).cast("int")).alias("language"), posterior.alias("posterior"),
        F.element_at(names, F.col("best") + 1).alias("text_language"), "declared", (~F.col("letters") | ~F.col("fits") | (posterior < sure)).alias("rejected"),
    )


def identify_documents(docs: DataFrame) -> DataFrame:
    """Documents: ``lang`` is the declared language, ``source`` the host; there is no address."""
    nothing = F.lit(None).cast("string")
    return identify(docs, "doc_id", "text", F.col("lang"), F.col("source"), F.lit(""), nothing)


def identify_pages(pages: DataFrame) -> DataFrame:
    """Pages: the markup's language, the host and its site (the last two labels), and the address's language part."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]*)", 1))
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    part = F.lower(F.regexp_extract(url, r"^[^:]+://[^/]*/([a-zA-Z]{2})(?:[/?#]|$)", 1))
    domain = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    by_domain = F.create_map(*[F.lit(x) for p in DOMAIN_LANGUAGE.items() for x in p])
    suffix = F.coalesce(F.nullif(part, F.lit("")), F.try_element_at(by_domain, domain))
    lang = F.regexp_extract(F.col("html"), r"(?is)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})", 1)
    text = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?(?:</\1\s*>|\z)", " "), r"<[^<>]*+>", " ")  # linear, whatever is left open
    return identify(pages.withColumn("plain", text), "page_id", "plain", lang, host, site, suffix)
