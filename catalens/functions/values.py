"""Numbers, identifiers, dates, URLs and small rules."""

from __future__ import annotations

import uuid
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------------------------
DEFAULT_ZONE = "Europe/Moscow"
ZONES = zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"}
LABEL_ALCOHOL = (5.0, 25.0)
CATALOG_ALCOHOL = (3.0, 25.0)
TEMPERATURE = (0.0, 25.0)
BONUS_THRESHOLD = 0.55
NICKNAME_PATTERN = "^[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9_.\\- ]{1,22}[A-Za-zА-Яа-яЁё0-9_]$"
REVIEW_FRAMES = ((101, "diamond"), (50, "gold"), (10, "silver"), (1, "bronze"))
# --------------------------------------------------------------------------------------------------

LABEL_NUMBER = "(\\d{1,2}(?:[.,]\\d{1,2})?)"
ANY_NUMBER = "(\\d+(?:[.,]\\d+)?)"


def numbers_in(text: Column, pattern: str = ANY_NUMBER) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)
    return F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit(".")).cast("double"))


def within(numbers: Column, bounds: tuple[float, float]) -> Column:
    return F.filter(numbers, lambda n: (n >= bounds[0]) & (n <= bounds[1]))


def alcohol_numbers(text: Column) -> Column:
    """Strength values of a label text: only texts with a percent sign count, then all their numbers do."""
    found = within(numbers_in(text, LABEL_NUMBER), LABEL_ALCOHOL)
    return F.when(F.contains(F.coalesce(text, F.lit("")), F.lit("%")), found).otherwise(F.array().cast("array<double>"))


def mean_of(numbers: Column) -> Column:
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc + n)
    return F.when(F.size(numbers) > 0, total / F.size(numbers))


def parse_alcohol_avg(text: Column) -> Column:
    return mean_of(within(numbers_in(text), CATALOG_ALCOHOL))


def plausible(text: Column, bounds: tuple[float, float]) -> Column:
    """At least one number, and every number within bounds."""
    numbers = numbers_in(text)
    return (F.size(numbers) > 0) & F.forall(numbers, lambda n: (n >= bounds[0]) & (n <= bounds[1]))


def format_number(number: Column) -> Column:
    """Shortest decimal form of moderate numbers (12.0 → 12, 12.50 → 12.5)."""
    text = F.format_string("%.4f", number.cast("double"))
    short = F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")
    return F.when(number.isNotNull(), short)  # format_string prints NULL as a word


def format_percent_range(low: Column, high: Column) -> Column:
    """`a-b%` when both are known and differ, else the known one with a percent sign."""
    lo, hi = format_number(low), format_number(high)
    return F.when(lo.isNotNull() & hi.isNotNull() & (lo != hi), F.concat(lo, F.lit("-"), hi, F.lit("%"))).otherwise(
        F.concat(F.coalesce(lo, hi), F.lit("%"))
    )


def format_temperature(text: Column) -> Column:
    clean = F.trim(F.replace(F.replace(F.replace(F.trim(text), F.lit("–"), F.lit("-")), F.lit("°C"), F.lit("")), F.lit("°"), F.lit("")))
    return F.when(F.trim(text) != "", F.concat(clean, F.lit("°C")))


def uuid5(namespace: uuid.UUID | str, name: Column) -> Column:
    """Name-based version-5 UUID, equal to the standard one."""
    prefix = uuid.UUID(str(namespace)).hex
    digest = F.sha1(F.concat(F.unhex(F.lit(prefix)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def stable_shuffle(identifier: Column) -> Column:
    """CRC-32 of the id text: a fixed pseudo-random tie order."""
    return F.crc32(F.encode(identifier, "UTF-8"))


def idf_smooth(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1.0


def idf_pool(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def clip_bonus(score: Column) -> Column:
    scaled = (score - BONUS_THRESHOLD) / (1.0 - BONUS_THRESHOLD)
    return F.when(score < 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled)))


def local_time(ts: Column, zone: Column) -> Column:
    """UTC timestamp in the user's zone; a missing or unknown zone means the default one."""
    return F.from_utc_timestamp(ts, F.when(zone.isin(*sorted(ZONES)), zone).otherwise(DEFAULT_ZONE))


def pseudonymise(identifier: Column) -> Column:
    text = identifier.cast("string")
    return F.when(text.isNotNull() & (text != ""), F.concat(F.lit("anon:"), F.substring(F.sha2(text, 256), 1, 10))).otherwise("anon")


def normalize_email(email: Column) -> Column:
    return F.lower(F.trim(email))


def valid_nickname(name: Column) -> Column:
    return name.rlike(NICKNAME_PATTERN) & ~F.contains(name, F.lit("  "))


def review_frame(count: Column) -> Column:
    result = F.lit("none")
    for bound, label in reversed(REVIEW_FRAMES):
        result = F.when(count >= bound, label).otherwise(result)
    return result


def query_keys(query: Column) -> Column:
    """Distinct parameter names of a query string in order of appearance."""
    names = F.transform(F.split(F.coalesce(query, F.lit("")), "&"), lambda part: F.substring_index(part, "=", 1))
    return F.array_distinct(F.filter(names, lambda name: name != ""))


def relative_gap(first: Column, second: Column) -> Column:
    """Lead of the best over the second; infinite when there is no usable second, 0 without any."""
    return (
        F.when(first.isNull(), 0.0)
        .when(second.isNull() | (second <= 0), F.lit(float("inf")))
        .otherwise((first - second) / second)
    )


def normalize_photo_dir(line: Column) -> Column:
    """Photo folder from a list or raw log line; headers and blanks become NULL."""
    text = F.trim(F.regexp_replace(line, "^.*__main__:", ""))
    folder = F.regexp_replace(F.regexp_replace(text, "(^|/)original\\.jpg$", ""), "^/+|/+$", "")
    return F.when((text != "") & ~text.rlike("^(Missing|Processed) "), folder)


def source_kind(photo_id: Column) -> Column:
    return F.substring_index(photo_id, "_", 1)


def slug_from_url(url: Column, folder: str = "wines") -> Column:
    """Last segment when the path is exactly `<folder>/<slug>`, else NULL."""
    path = F.regexp_replace(F.parse_url(url, F.lit("PATH")), "^/+|/+$", "")
    parts = F.split(path, "/")
    return F.when((F.size(parts) == 2) & (F.get(parts, F.lit(0)) == folder) & (F.get(parts, F.lit(1)) != ""), F.get(parts, F.lit(1)))
