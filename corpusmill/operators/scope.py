"""What of a source is in scope, and what curated tables say about it.  All predicates are expressions that push down
or stay in generated code; the curated sides are joined without a hint, so their size decides how."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def below(path: Column, prefix: str) -> Column:
    """Path begins with a prefix, taken literally (no wildcards)."""
    return path.startswith(prefix)


def lead_between(section: Column, first: int, last: int) -> Column:
    """The digits that a section number begins with lie in a range; false without digits."""
    return F.coalesce(F.regexp_extract(section, r"^(\d{1,18})(?!\d)", 1).try_cast("long").between(first, last), F.lit(False))


def in_scope(section: Column, *patterns: str) -> Column:
    """Any of the patterns fits from the section's start; none given: all is in scope."""
    hit = F.lit(not patterns)
    for p in patterns:
        hit = hit | section.rlike(f"^(?:{p})")
    return F.coalesce(hit, F.lit(False))


def is_section_link(slug: Column, prefix: str) -> Column:
    """A digit follows the code's prefix and an underscore; other slugs of the code are containers."""
    return F.coalesce(slug.rlike(f"^{re.escape(prefix)}_[0-9]"), F.lit(False))


def allowed(rows: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the registry lists."""
    return rows.join(registry.select(*keys), keys, "left_semi")


def of_kinds(rows: DataFrame, kinds: dict[str, bool], kind: str = "kind") -> DataFrame:
    """Rows of the kinds that are switched on."""
    return rows.filter(F.col(kind).isin([k for k, on in kinds.items() if on]))


def curated(sections: DataFrame, topics: DataFrame, key: str, defaults: dict[str, str]) -> DataFrame:
    """Sections with the columns of a curated table, which has one row a key; the defaults where it has none or null."""
    wanted = topics.select(key, *(F.col(c).alias(f"__{c}") for c in defaults))
    joined = sections.drop(*defaults).join(wanted, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in defaults.items()}).drop(*(f"__{c}" for c in defaults))


#: The chapter's two editions, the sections that the later one has, topics and stages of sections, and of all others.
BASE_EDITION = ("https://www.cga.ct.gov/2023/pub/chap_815j.htm", "2023")
SUPPLEMENT = ("https://www.cga.ct.gov/2024/sup/chap_815j.htm", "2024 supplement")
SUPPLEMENTED = ("46b-44a", "46b-53", "46b-56e", "46b-67", "46b-82a", "46b-83", "46b-84")
TOPICS = {
    "46b-40": ("grounds-for-dissolution", "pre-filing"), "46b-44": ("residency-and-jurisdiction", "pre-filing"), "46b-44a": ("nonadversarial-dissolution", "pre-filing"), "46b-45": ("service-and-filing", "filing"),
    "46b-56": ("custody-and-best-interests", "temporary-orders"), "46b-67": ("case-timing", "after-filing"), "46b-81": ("property-division", "judgment"), "46b-82": ("alimony", "judgment"),
    "46b-82a": ("alimony-family-violence", "judgment"), "46b-83": ("temporary-alimony-and-support", "temporary-orders"), "46b-84": ("child-support", "temporary-orders"), "46b-86": ("postjudgment-modification", "postjudgment"),
}
OTHER_TOPIC, OTHER_STAGE = "dissolution", "trial"


def editions(sections: DataFrame, supplemented: DataFrame, base: tuple[str, str], supplement: tuple[str, str], key: str = "section") -> DataFrame:
    """Sections with the url and date of the edition that holds: the supplement's for those it has, else the base's."""
    later = supplemented.select(F.col(key).alias("__k")).distinct()
    there = sections.join(later, F.col(key) == F.col("__k"), "left")
    pick = lambda k: F.when(F.col("__k").isNotNull(), supplement[k]).otherwise(base[k])
    return there.withColumns({"url": pick(0), "date": pick(1)}).drop("__k")


def statute_specs(sections: DataFrame) -> DataFrame:
    """What is fetched for each section of the chapter, with its metadata."""
    spark = sections.sparkSession
    supplemented = spark.createDataFrame([(s,) for s in SUPPLEMENTED], "section string")
    topics = spark.createDataFrame([(k, *v) for k, v in TOPICS.items()], "section string, topic string, stage string")
    placed = curated(editions(sections, supplemented, BASE_EDITION, SUPPLEMENT), topics, "section", {"topic": OTHER_TOPIC, "stage": OTHER_STAGE})
    named = lambda before, after="": F.concat(F.lit(before), "section", F.lit(after))
    fixed = {"source_type": "statute", "authority_level": "primary", "jurisdiction": "Connecticut", "issuing_body": "Connecticut General Assembly"}
    return placed.withColumns({"slug": named("cgs-"), "output_path": named("statutes/cgs-", ".txt"), "citation": named("Conn. Gen. Stat. § "), "title": named("CGS § "), **{k: F.lit(v) for k, v in fixed.items()}})


def state_courts(registry: DataFrame) -> DataFrame:
    """slug, court of each court of each state; a null court where a state has none."""
    return registry.select("slug", F.explode_outer("courtlistener_courts").alias("court"))


def padded_number(section: Column, width: int = 5) -> Column:
    """`47` as `00047`; null if it isn't a whole number."""
    digits = F.regexp_extract(section, r"^0*(\d+)$", 1)
    return F.when(digits != "", F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def title_number(tail: Column, title: str) -> Column:
    """`00312` under title 25 as `25-312`; null if it isn't a whole number."""
    digits = F.regexp_extract(tail, r"^0*(\d+)$", 1)
    return F.when(digits != "", F.concat(F.lit(f"{title}-"), digits))


def dotted_name(section: Column, code: str) -> Column:
    """`580-10.5` of code HRS as `HRS_0580-0010_0005`: every number in four digits; null in another form."""
    form = r"^(\d{1,4})-(\d{1,4})(?:\.(\d{1,4}))?$"
    part = lambda k: F.lpad(F.regexp_extract(section, form, k), 4, "0")
    name = F.concat(F.lit(f"{code}_"), part(1), F.lit("-"), part(2))
    return F.when(section.rlike(form), F.when(F.regexp_extract(section, form, 3) != "", F.concat(name, F.lit("_"), part(3))).otherwise(name))


def citation_number(slug: Column, code: str) -> Column:
    """`mcl-552-9` of code mcl as `552.9`; null in another form."""
    form = rf"^{re.escape(code)}-(\d+)-(.+)$"
    return F.when(slug.rlike(form), F.concat_ws(".", F.regexp_extract(slug, form, 1), F.regexp_extract(slug, form, 2)))
