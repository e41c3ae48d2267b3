"""Route templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOLE = "{x}"


def skeleton(route: Column) -> Column:
    """The route in lower case without query, fragment and outer slashes, every {...} as {x}; blank for blank."""
    cut = F.split_part(F.split_part(route, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    plain = F.regexp_replace(F.regexp_replace(F.lower(cut), r"\{[^}]*\}", r"\{x\}"), "/{2,}", "/")
    return F.when(F.coalesce(route, F.lit("")).rlike(r"^\s*$"), "").otherwise(F.regexp_replace(plain, "^/+|/+$", ""))


def segments(route_skeleton: Column) -> Column:
    return F.split(route_skeleton, "/", -1)


def segments_match(a: Column, b: Column) -> Column:
    """Equal numbers of segments, and in each place equal ones or a hole on either side."""
    each = F.zip_with(a, b, lambda x, y: (x == y) | (x == HOLE) | (y == HOLE))
    return (F.size(a) == F.size(b)) & F.coalesce(F.forall(each, lambda ok: F.coalesce(ok, F.lit(False))), F.lit(False))


def matches(a: Column, b: Column) -> Column:
    """Whether two skeletons can name the same route."""
    return (a == b) | segments_match(segments(a), segments(b))


def verb(fqn: Column) -> Column:
    """The first word of an endpoint's or call site's name."""
    return F.split_part(fqn, F.lit(" "), F.lit(1))


def compose(prefix: Column, pattern: Column) -> Column:
    """prefix and pattern as one template with single slashes; no slash at the end but for the root."""
    joined = F.regexp_replace(F.concat(F.lit("/"), F.coalesce(prefix, F.lit("")), F.lit("/"), F.coalesce(pattern, F.lit(""))), "/{2,}", "/")
    return F.when(F.length(joined) > 1, F.regexp_replace(joined, "/$", "")).otherwise(joined)


def combine_prefix(parent: Column, segment: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", segment).otherwise(F.concat_ws("/", parent, segment))


def without_suffix(text: Column, suffix: str) -> Column:
    """The text without the suffix, if there is more than the suffix."""
    return F.when(text.endswith(suffix) & (F.length(text) > len(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def fill_tokens(template: Column, controller: Column, action: Column, area: Column) -> Column:
    """[controller], [action] and [area] filled in, in any case; null if another token is left or area is missing."""
    text = F.regexp_replace(template, F.lit(r"(?i)\[controller\]"), without_suffix(controller, "Controller"))
    text = F.regexp_replace(text, F.lit(r"(?i)\[action\]"), without_suffix(action, "Async"))
    text = F.when(area.isNotNull(), F.regexp_replace(text, F.lit(r"(?i)\[area\]"), F.coalesce(area, F.lit("")))).otherwise(text)
    return F.when(~text.rlike(r"\[\w+\]"), text)


def is_absolute(template: Column) -> Column:
    return template.startswith("~/") | template.startswith("/")


def fetch_verb(method: Column, literal: Column) -> Column:
    """The verb of a fetch call: GET without a method, UNKNOWN if it isn't a literal."""
    return F.when(method.isNull(), "GET").when(~literal, "UNKNOWN").otherwise(F.upper(method))


def client_verb(method: Column) -> Column:
    """The verb of a client's method name; null if it is none."""
    names = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "del": "DELETE", "patch": "PATCH"}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), method)


def is_url_shaped(argument: Column) -> Column:
    return F.coalesce(argument.startswith("/"), F.lit(False))
