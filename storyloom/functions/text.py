"""Text, hash, date and JSON functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from storyloom.functions.urls import canonical
from storyloom.schemas import BARE, BOILERPLATE, DOMAINS, FENCE, FENCE_END, HREF, LIST_ADDRESS, TAGS, TRAILING_COMMA



def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def normalised_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(title), "[\\p{P}\\p{S}]+", " "))


def normalised_headline(headline: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(headline), "[^\\p{L}\\p{N}]+", " "))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical(url), 256)


def title_hash(title: Column) -> Column:
    return F.sha2(normalised_title(title), 256)


def query_hash(query: Column, start: Column, end: Column) -> Column:
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.sha2(F.to_json(F.struct(squeeze(F.lower(query)).alias("query"), iso(start).alias("startDate"), iso(end).alias("endDate"))), 256)


def without_boilerplate(body: Column) -> Column:
    """The text before the first footer line that has a line of content before it; trailing blanks go."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n")
    footer = lambda line: F.lower(line).rlike("|".join(f"(?:{p})" for p in BOILERPLATE))
    places = lambda test: F.filter(F.transform(lines, lambda line, i: F.when(test(line), i)), lambda i: i.isNotNull())
    content = F.array_min(places(lambda line: (F.trim(line) != "") & ~footer(line)))
    cut = F.array_min(F.filter(places(footer), lambda i: i > content))
    kept = F.slice(lines, F.lit(1), F.coalesce(cut, F.size(lines)))
    return F.regexp_replace(F.array_join(kept, "\n"), "\\s+$", "")


def links(html: Column, text: Column) -> Column:
    """Distinct links in order: of anchors if there is HTML, else bare URLs."""
    found = F.when(F.length(html) > 0, F.regexp_extract_all(html, F.lit(HREF), 1)).otherwise(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BARE), 0))
    good = lambda u: (u != "") & ~u.rlike("^(#|mailto:|javascript:|tel:)") & ~u.rlike(LIST_ADDRESS)
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), good))


def message_id(header: Column, subject: Column, sender: Column, date: Column, text: Column, html: Column, domain: str = "inbox.example") -> Column:
    none = F.lit("")
    body = F.substring(F.when(F.length(text) > 0, text).otherwise(F.coalesce(html, none)), 1, 4096)
    mixed = F.sha2(F.concat_ws("\n", F.coalesce(subject, none), F.coalesce(sender, none), F.coalesce(date, none), body), 256)
    return F.coalesce(header, F.concat(F.lit("<synth-"), F.substring(mixed, 1, 32), F.lit(f"@{domain}>")))


def embedding_input(summary: Column, context: Column, entities: Column) -> Column:
    return F.concat(summary, F.lit("\n\n"), context, F.when(F.size(entities) > 0, F.concat(F.lit("\nEntities: "), F.array_join(entities, ", "))).otherwise(""))


def half_life(domain: Column) -> Column:
    return F.create_map(*[F.lit(x) for name, (hours, _, _) in DOMAINS.items() for x in (name, float(hours))])[domain]


def recency_decay(published: Column, as_of: Column, domain: Column) -> Column:
    hours = (F.unix_micros(as_of) - F.unix_micros(published)) / 3.6e9
    return F.when(hours <= 0, 1.0).otherwise(F.exp(-F.log(F.lit(2.0)) * hours / half_life(domain)))


def escaped(text: Column, apostrophe: str, strip_controls: bool) -> Column:
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "") if strip_controls else text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def snippet(text: Column, most: int = 480) -> Column:
    flat = squeeze(text)
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(flat, 1, most - 1), F.lit("…")))


def unfenced(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, FENCE, ""), FENCE_END, ""))


def without_trailing_commas(raw: Column) -> Column:
    return F.regexp_replace(raw, TRAILING_COMMA, "$1")


def kind_of(json: Column, path: str) -> Column:
    """The JSON type at a path: OBJECT, ARRAY, STRING, number types; null if absent."""
    return F.schema_of_variant(F.try_variant_get(json, path, "variant"))


def full_text(json: Column, path: str) -> Column:
    return (kind_of(json, path) == "STRING") & (F.length(F.try_variant_get(json, path, "string")) > 0)


def json_text(json: Column, path: str = "$") -> Column:
    """The text at a path; null if it is of another type."""
    return F.when(kind_of(json, path) == "STRING", F.try_variant_get(json, path, "string"))


def json_number(json: Column, path: str = "$") -> Column:
    """The number at a path; null if it is of another type."""
    return F.when(kind_of(json, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(json, path, "double"))


def json_items(json: Column, path: str = "$") -> Column:
    """The array at a path, of any elements; null if it is of another type, as nothing else is made an array."""
    return F.try_variant_get(json, path, "array<variant>")


def with_json_field(json: Column, name: str, value: Column) -> Column:
    """A JSON object as text with one field set; null, malformed JSON and what is no object count as an empty object."""
    v = F.try_parse_json(json)
    old = F.when(F.schema_of_variant(v).startswith("OBJECT"), v.cast("map<string,variant>"))
    kept = F.coalesce(F.map_filter(old, lambda k, _: k != name), F.create_map().cast("map<string,variant>"))
    return F.to_json(F.map_concat(kept, F.create_map(F.lit(name), value.cast("variant"))))


def text_list(json: Column, path: str) -> Column:
    """The array of strings at a path; null if it is anything else."""
    return F.when(kind_of(json, path).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get(json, path, "array<string>"))


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that doesn't hold; null if all do."""
    out = None
    for name, holds in rules:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out


def item_failure(raw: Column) -> Column:
    v = F.try_parse_json(unfenced(raw))
    domains, keywords = text_list(v, "$.domains"), text_list(v, "$.keywords")
    primary = F.try_variant_get(v, "$.primary_domain", "string")
    return first_failure(
        ("json", v.isNotNull()),
        ("object", F.schema_of_variant(v).startswith("OBJECT")),
        ("text", full_text(v, "$.summary_en") & full_text(v, "$.context_en") & full_text(v, "$.primary_domain")),
        ("list", text_list(v, "$.entities").isNotNull() & domains.isNotNull() & keywords.isNotNull()),
        ("domain", F.forall(domains, lambda d: d.isin(*DOMAINS)) & primary.isin(*DOMAINS)),
        ("primary", F.array_contains(domains, primary)),
        ("keywords", F.size(keywords).between(3, 7)),
    )


def summary_failure(raw: Column) -> tuple[Column, Column, Column]:
    """Failure, the tags that stay and how many were dropped."""
    v = F.try_parse_json(unfenced(raw))
    keywords, tags = text_list(v, "$.keywords"), text_list(v, "$.tags")
    failure = first_failure(
        ("json", v.isNotNull()),
        ("object", F.schema_of_variant(v).startswith("OBJECT")),
        ("text", full_text(v, "$.headline") & full_text(v, "$.context_summary")),
        ("list", keywords.isNotNull() & tags.isNotNull()),
        ("keywords", F.size(keywords).between(5, 8)),
    )
    return failure, F.slice(F.array_distinct(F.filter(tags, lambda t: t.isin(TAGS))), 1, 3), F.size(F.filter(tags, lambda t: ~t.isin(TAGS)))


def curation_failure(raw: Column) -> tuple[Column, Column]:
    plain = unfenced(raw)
    v = F.coalesce(F.try_parse_json(plain), F.try_parse_json(without_trailing_commas(plain)))
    score = F.try_variant_get(v, "$.curation_score", "double")
    failure = first_failure(
        ("json", v.isNotNull()),
        ("object", F.schema_of_variant(v).startswith("OBJECT")),
        ("number", kind_of(v, "$.curation_score").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & ~F.isnan(score)),
        ("range", score.between(0, 100)),
        ("text", full_text(v, "$.curation_rationale")),
    )
    return failure, F.when(failure.isNull(), score)


def publisher(raw: Column) -> Column:
    """A publisher's classification as a struct: failure, and if there is none slug, name, primary_domain, domains, authority, language, reasoning.

    Noise around the outermost braces goes. The slug is lower-cased, unknown domains go, authority is rounded and clamped, an
    empty language is ``en``; of the reasoning the first 500 characters stay, and one that isn't text is empty.
    """
    v = F.try_parse_json(F.regexp_extract(raw, "(?s)(\\{.*\\})", 1))
    text = lambda path: F.try_variant_get(v, path, "string")
    slug, primary = F.lower(text("$.slug")), text("$.primary_domain")
    domains = F.filter(text_list(v, "$.domains"), lambda d: d.isin(*DOMAINS))
    failure = first_failure(
        ("json", v.isNotNull()),
        ("slug", slug.rlike("^[a-z0-9][a-z0-9-]*$")),
        ("domain", primary.isin(*DOMAINS)),
        ("domains", (F.size(domains) > 0) & (F.get(domains, F.lit(0)) == primary)),
        ("authority", kind_of(v, "$.authority").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")),
        ("name", full_text(v, "$.name")),
    )
    authority = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(F.try_variant_get(v, "$.authority", "double") + 0.5).cast("int")))
    language = F.when(full_text(v, "$.language"), text("$.language")).otherwise("en")
    reasoning = F.when(full_text(v, "$.reasoning"), F.substring(text("$.reasoning"), 1, 500)).otherwise("")
    fields = {"slug": slug, "name": text("$.name"), "primary_domain": primary, "domains": domains, "authority": authority, "language": language, "reasoning": reasoning}
    return F.struct(failure.alias("failure"), *(F.when(failure.isNull(), c).alias(n) for n, c in fields.items()))
