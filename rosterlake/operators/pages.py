"""Profile pages of companies: slugs found in archived search results, and whether a page is the company's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.text import domain_key, let

# Words that turn a one-word name into another company's.
QUALIFIERS = ("consulting", "consultants", "consultancy", "advisors", "advisory", "partners", "associates", "holdings", "group", "ventures", "capital", "agency", "services", "solutions")
# Slugs that are no company's, and marks of a result page that is a captcha.
DENIED = ("linkedin", "linkedin-corporation", "company", "showcase")
CAPTCHA = ("captcha", "recaptcha", "verify you are a human")
SLUG = r"(?i)linkedin\.com/company/([A-Za-z0-9_%.\-]+)"


def result_slugs(body: Column | str, limit: int = 5, denied: tuple[str, ...] = DENIED) -> Column:
    """Up to `limit` distinct slugs of a search result page: direct links first, then those behind redirects (u=, uddg=); none of a captcha."""
    b = F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit(""))
    direct = F.regexp_extract_all(b, F.lit(SLUG), F.lit(1))
    targets = F.regexp_extract_all(b, F.lit(r"(?i)[?&;](?:u|uddg)=([^&\"'<> ]+)"), F.lit(1))
    behind = F.filter(F.transform(targets, lambda t: F.regexp_extract(F.coalesce(F.try_url_decode(t), F.lit("")), SLUG, 1)), lambda s: s != "")
    clean = F.transform(F.concat(direct, behind), lambda s: F.lower(F.regexp_replace(s, r"[.%]+$", "")))
    found = F.slice(F.filter(F.array_distinct(clean), lambda s: (s != "") & ~s.isin(*denied)), 1, limit)
    return F.when(F.lower(b).rlike("|".join(CAPTCHA)), F.array().cast("array<string>")).otherwise(found)


def name_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def page_title(body: Column) -> Column:
    """The og:title, else the title, without a trailing site name."""
    og = F.regexp_extract(body, r"(?is)<meta[^>]*property=[\"']og:title[\"'][^>]*content=[\"']([^\"']*)", 1)
    title = F.trim(F.coalesce(F.nullif(og, F.lit("")), F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)))
    return F.regexp_replace(title, r"(?i)\s[|-]\slinkedin.*$", "")


def _long(tokens: Column) -> Column:
    longer = F.filter(tokens, lambda t: F.length(t) >= 3)
    return F.when(F.size(longer) > 0, longer).otherwise(tokens)


def judged_pages(pages: DataFrame) -> DataFrame:
    """pages (company_id, name, domain, body) with accepted and reason.

    A title must share a word with the name.  A page that mentions the domain
    is the company's; else a one-word name is refused when the title adds a
    qualifier, or when a domain is known.
    """
    words = F.struct(_long(name_tokens(page_title(F.coalesce("body", F.lit(""))))).alias("title"), _long(name_tokens(F.coalesce("name", F.lit("")))).alias("called"))

    def reason(w: Column) -> Column:
        extra = F.filter(F.array_except(w.title, w.called), lambda t: t.isin(*QUALIFIERS))
        mentioned = F.coalesce(F.contains(F.lower("body"), domain_key("domain")), F.lit(False))
        one = F.size(w.called) == 1
        return (
            F.when(~F.arrays_overlap(w.title, w.called), "no_token_overlap")
            .when(mentioned, "domain_in_body")
            .when(one & (F.size(extra) > 0), F.concat(F.lit("ambiguous_qualifier:"), F.get(extra, F.lit(0))))
            .when(one & domain_key("domain").isNotNull(), "single_token_no_domain_in_body")
            .otherwise("ok")
        )

    return pages.withColumn("reason", let(words, reason)).withColumn("accepted", F.col("reason").isin("domain_in_body", "ok"))
