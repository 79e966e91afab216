"""URL columns with the semantics of Python's ``urllib.parse``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import col, let, strip_blank

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
_EMPTY_PARAMETERS = r"(?s)^((?:[A-Za-z][A-Za-z0-9+.-]*+:)?+(?://[^/?#]*+)?+(?:[^?#]*/)?[^/;?#]*);$"
_PATH = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_decode(value: str | Column) -> Column:
    """Percent-decode; ``+`` and malformed ``%`` stay as they are."""
    value = col(value)
    escaped = F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    return F.when(value.contains("%"), decoded).otherwise(value)


def form_decode(value: str | Column) -> Column:
    """Percent-decode a form value, where ``+`` stands for a blank."""
    value = col(value)
    decoded = F.try_url_decode(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"))
    return F.when(value.contains("%"), decoded).otherwise(F.translate(value, "+", " "))


def form_encode(value: str | Column) -> Column:
    """Encode a form value; ``*`` is escaped and ``~`` is not."""
    encoded = F.replace(F.url_encode(col(value)), F.lit("*"), F.lit("%2A"))
    return F.replace(encoded, F.lit("%7E"), F.lit("~"))


def page_to_path(value: str | Column) -> Column:
    """Path of a URL without the parameters of its last segment; empty when there is none."""
    return F.regexp_replace(F.regexp_extract(col(value), _PATH, 1), r"(?s);[^/]*$", "")


def path_only(value: str | Column) -> Column:
    """Path of a URL, or the whole value when the path is empty."""
    path = page_to_path(value)
    return F.when(path == "", col(value)).otherwise(path)


def _lower_scheme(value: Column) -> Column:
    scheme = F.regexp_extract(value, _SCHEME, 0)
    return F.concat(F.lower(scheme), F.substr(value, F.length(scheme) + 1))


def _rebuilt_prefix(value: Column) -> Column:
    """URL up to its query in rebuilt form: scheme in lower case, no empty parameters (a lone ``;``) at the end."""
    prefix = F.regexp_extract(_lower_scheme(value), r"(?s)^[^?#]*", 0)
    return F.when(prefix.endswith(";"), F.regexp_replace(prefix, _EMPTY_PARAMETERS, "$1")).otherwise(prefix)


def strip_qs(value: str | Column) -> Column:
    """Drop query and fragment."""
    return _rebuilt_prefix(col(value))


def form_pairs(query: Column, with_position: bool = True) -> Column:
    """Array of (name, value[, position]) of a query text, decoded, valueless names kept."""
    items = F.filter(F.split(query, "&"), lambda item: item != "")

    def pair(item: Column, position: Column) -> Column:
        cut = F.instr(item, "=")
        raw_name = F.when(cut > 0, F.substring_index(item, "=", 1)).otherwise(item)
        raw_value = F.when(cut > 0, F.substr(item, cut + 1)).otherwise(F.lit(""))
        fields = [form_decode(raw_name).alias("name"), form_decode(raw_value).alias("value")]
        return F.struct(*fields, *([position.alias("position")] if with_position else []))

    return F.transform(items, pair)


def url_query(value: str | Column) -> Column:
    return F.regexp_extract(col(value), r"(?s)^[^?#]*\?([^#]*)", 1)


def keep_qs(value: str | Column, names: Sequence[str]) -> Column:
    """Keep the listed query parameters; the fragment stays.

    Parameters stand in URL order, repeated names together at their first occurrence.
    """
    value = col(value)
    kept = F.filter(form_pairs(url_query(value)), lambda p: p["name"].isin(list(names)))

    def rebuilt(pairs: Column) -> Column:
        def place(p: Column) -> Column:
            first = F.array_position(pairs["name"], p["name"])
            return F.struct(first.alias("first"), p["position"], p["name"], p["value"])

        items = F.transform(
            F.array_sort(F.transform(pairs, place)),
            lambda p: F.concat(form_encode(p["name"]), F.lit("="), form_encode(p["value"])),
        )
        return F.array_join(items, "&")

    query = let(kept, rebuilt)
    prefix = _rebuilt_prefix(value)
    fragment = F.regexp_extract(value, r"(?s)^[^#]*(#.+)$", 1)
    shown = let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q)))
    return F.concat(prefix, shown, fragment)


def normalize_page(value: str | Column) -> Column:
    """Decode, then cut at the first ``?`` and ``#``, then lower-case."""
    return F.lower(F.substring_index(F.substring_index(url_decode(value), "?", 1), "#", 1))


def normalize_domain(value: str | Column) -> Column:
    """Host of a URL or source text in lower case, without scheme, ``www.`` and path."""
    return F.regexp_extract(
        F.lower(strip_blank(value)), r"(?s)^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:www\.)?([^/?#]*)", 1
    )


# Loopback names and the private IPv4 ranges.
_PRIVATE_HOST = (
    r"localhost|\[::1\]|::1"
    r"|127\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    r"|10\.\d{1,3}\.\d{1,3}\.\d{1,3}"
    r"|192\.168\.\d{1,3}\.\d{1,3}"
    r"|172\.(?:1[6-9]|2\d|3[01])\.\d{1,3}\.\d{1,3}"
)


def is_private_source(value: str | Column) -> Column:
    """True when a source is a local or private host; scheme, port and path may be present."""
    text = F.lower(strip_blank(value))
    return F.coalesce(
        text.rlike(rf"^(?:[a-z][a-z0-9+.-]*://)?(?:{_PRIVATE_HOST})(?::\d+)?(?:[/?#].*)?$"), F.lit(False)
    )


def trailing_slash(value: str | Column) -> Column:
    """Append ``/`` unless the path ends in one or its last segment has an extension."""
    value = col(value)
    done = value.rlike(r"(?s)/\z|(?:^|/)[^/]*\.[^/.]+\z")
    return F.when(done, value).otherwise(F.concat(value, F.lit("/")))


def site_key(value: str | Column) -> Column:
    """Join key of a site URL: a trailing slash is ignored for http(s) URLs only."""
    text = strip_blank(value)
    return F.when(text.rlike(r"^https?://"), F.regexp_replace(text, r"/+$", "")).otherwise(text)


def site_spellings(key: str | Column) -> Column:
    """URLs as they are stored that have a site key: the key, and of http(s) URLs also with a slash at the end."""
    text = col(key)
    return F.when(text.rlike(r"^https?://"), F.array(text, F.concat(text, F.lit("/")))).otherwise(F.array(text))
