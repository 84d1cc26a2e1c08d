"""Answer policy: verdicts from nested assessments, score gates, and masking of financial personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .dom import let

#: Refusals, thresholds, response schema, and the patterns that are masked.
REFUSALS = {"grounding": "The answer could not be grounded in the sources.", "topic": "This topic is outside what can be answered.", "content": "This request or answer can't be shown."}
LEAST_GROUNDING, LEAST_RELEVANCE = 0.75, 0.5
_ENTRY = "array<struct<name:string,type:string,filterStrength:string,action:string,match:string,score:double>>"
SCHEMA = f"struct<action:string,assessments:array<struct<contextualGroundingPolicy:struct<filters:{_ENTRY}>,topicPolicy:map<string,{_ENTRY}>,contentPolicy:map<string,{_ENTRY}>,wordPolicy:map<string,{_ENTRY}>,sensitiveInformationPolicy:struct<piiEntities:{_ENTRY},regexes:{_ENTRY}>>>,outputs:array<struct<text:string>>>"
PII = {
    "ssn": r"\b[0-8]\d{2}-\d{2}-\d{4}\b", "itin": r"\b9\d{2}-\d{2}-\d{4}\b", "routing": r"(?i)\brouting(?: number| no\.?)?[:# ]+\d{9}\b", "account": r"(?i)\baccount(?: number| no\.?)?[:# ]+\d{6,17}\b",
    "cvv": r"(?i)\bcvv2?[:# ]+\d{3,4}\b", "pin": r"(?i)\bpin[:# ]+\d{4,6}\b", "password": r"(?i)\bpassword[:= ]+\S+",
}
CARD = r"\b(?:\d[ -]?){12,18}\d\b"


def _entries(part: Column) -> Column:
    return F.coalesce(part, F.array().cast(_ENTRY))


def _named(entries: Column, actions: tuple[str, ...], fallback: str) -> Column:
    return F.transform(F.filter(entries, lambda e: e["action"].isin(*actions)), lambda e: F.coalesce(*(F.when(e[c] != "", e[c]) for c in ("name", "type", "filterStrength")), F.lit(fallback)))


def verdicts(responses: DataFrame) -> DataFrame:
    """id, blocked, masked, text, reasons from (id, side, original, resp JSON).

    Grounding comes before topic before content and words before blocked personal data; on the input side
    personal data is let pass; no intervention, an unreadable or a missing response lets the original pass.
    """
    r = responses.withColumn("__a", F.from_json("resp", SCHEMA))
    output = F.col("side") == "output"
    each = lambda f: F.flatten(F.transform(F.coalesce("__a.assessments", F.array()), f))
    policy = lambda key: each(lambda a: _named(F.flatten(F.map_values(F.coalesce(a[key], F.create_map().cast(f"map<string,{_ENTRY}>")))), ("BLOCKED", "DENIED"), key))
    grounding = each(lambda a: F.transform(F.filter(_entries(a["contextualGroundingPolicy"]["filters"]), lambda e: e["action"] == "BLOCKED"), lambda e: F.concat(F.lit("ungrounded:"), F.lower(F.coalesce(e["type"], F.lit("grounding"))))))
    personal = each(lambda a: F.concat(_entries(a["sensitiveInformationPolicy"]["piiEntities"]), _entries(a["sensitiveInformationPolicy"]["regexes"])))
    r = r.withColumns({
        "__g": grounding, "__t": policy("topicPolicy"), "__c": F.concat(policy("contentPolicy"), policy("wordPolicy")), "__p": personal,
        "__on": F.coalesce(F.col("__a.action") == "GUARDRAIL_INTERVENED", F.lit(False)),
    })
    stopped = F.exists("__p", lambda e: e["action"] == "BLOCKED")
    labels = F.transform(F.filter("__p", lambda e: e["action"].isin("ANONYMIZED", "BLOCKED")), lambda e: F.coalesce(e["type"], e["name"], F.lit("PII")))
    blocked = F.col("__on") & ((F.size("__g") > 0) | (F.size("__t") > 0) | (F.size("__c") > 0) | (stopped & output))
    masked = F.col("__on") & ~blocked & output & (F.size(labels) > 0)
    refusal = F.when(F.size("__g") > 0, REFUSALS["grounding"]).when(F.size("__t") > 0, REFUSALS["topic"]).otherwise(REFUSALS["content"])
    new_text = F.coalesce(F.get(F.filter(F.transform("__a.outputs", lambda o: o["text"]), lambda t: t != ""), 0), F.col("original"))
    reasons = F.concat("__g", "__t", "__c", F.when(stopped, F.array(F.lit("sensitive-info"))).otherwise(F.array().cast("array<string>")))
    return r.select("id", blocked.alias("blocked"), masked.alias("masked"), F.when(blocked, refusal).when(masked, new_text).otherwise(F.col("original")).alias("text"), F.when(blocked, reasons).when(masked, labels).otherwise(F.array().cast("array<string>")).alias("reasons"))


def gate(scores: DataFrame) -> DataFrame:
    return scores.filter((F.col("grounding") >= LEAST_GROUNDING) & (F.col("relevance") >= LEAST_RELEVANCE))


def luhn(number: Column) -> Column:
    """Whether the digits of a card number add up."""
    digits = F.reverse(F.filter(F.split(F.regexp_replace(number, r"\D", ""), ""), lambda d: d != ""))
    twice = lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(digits, lambda d, i: twice(d.cast("int"), i)), F.lit(0), lambda a, d: a + d) % 10 == 0


def pii_spans(text: Column) -> Column:
    """Where financial data is, as (start, end, kind) in order, characters from 0, end exclusive.

    All kinds are found in the text as it is; card numbers must add up.  Spans that overlap become one, of the kind of the
    one that begins first, the longer one on a tie, then the earlier kind of the list.
    """
    kinds = {**PII, "card": CARD}

    def found(k: int, kind: str, pattern: str) -> Column:
        matches, gaps = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), F.split(text, pattern)
        ends = F.aggregate(
            F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), F.array().cast("array<int>"),
            lambda done, x: F.when(x["m"].isNull(), done).otherwise(F.concat(done, F.array(F.coalesce(F.element_at(F.when(F.size(done) > 0, done), -1), F.lit(0)) + x["g"] + x["m"]))),
        )
        spans = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), (-e).alias("last"), F.lit(k).alias("order"), F.lit(kind).alias("kind"), m.alias("m")))
        spans = F.filter(spans, lambda s: luhn(s["m"])) if kind == "card" else spans
        return F.when(text.rlike(pattern), spans).otherwise(F.slice(spans_of_none, 1, 0))

    spans_of_none = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("last"), F.lit(0).alias("order"), F.lit("").alias("kind"), F.lit("").alias("m")))
    every = F.array_sort(F.concat(*(found(k, kind, pattern) for k, (kind, pattern) in enumerate(kinds.items()))))

    def joined(done: Column, s: Column) -> Column:
        new = F.struct(s["start"].alias("start"), (-s["last"]).alias("end"), s["kind"].alias("kind"))

        def against(last: Column) -> Column:
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], new["end"]).alias("end"), last["kind"].alias("kind"))
            return F.when(last.isNull() | (last["end"] <= s["start"]), F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer)))

        return let(F.element_at(F.when(F.size(done) > 0, done), -1), against)

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return F.when(text.rlike("|".join(kinds.values())), F.aggregate(every, none, joined)).otherwise(none)


def pii_counts(text: Column, spans: Column | None = None) -> dict[str, Column]:
    """How many spans of each kind mask_pii() replaces; a null text has none.

    Each count looks for the spans again, unless they are given: a column of pii_spans() of the text.
    """
    spans = pii_spans(F.coalesce(text, F.lit(""))) if spans is None else spans
    counted = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return {f"n_{kind}": counted(kind) for kind in (*PII, "card")}


def mask_pii(text: Column, spans: Column | None = None) -> Column:
    """Financial data replaced by its kind; names, mail, phone and address stay.  spans: of the text, if they are known."""

    def masked(spans: Column) -> Column:
        after = lambda i: F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
        pieces = F.transform(spans, lambda s, i: F.concat(F.substr(text, after(i) + 1, s["start"] - after(i)), F.lit("{"), F.upper(s["kind"]), F.lit("}")))
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.coalesce(F.element_at(F.when(F.size(spans) > 0, spans), -1)["end"], F.lit(0)) + 1))

    return let(pii_spans(text) if spans is None else spans, masked)
