"""Scalar functions over strings, ids and formats, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_record_id(c: Column) -> Column:
    """15 to 18 letters and digits, with a digit, not starting with three zeros."""
    return c.rlike("^[a-zA-Z0-9]{15,18}$") & c.rlike("[0-9]") & ~c.startswith("000")


def is_strict_record_id(c: Column) -> Column:
    return is_record_id(c) & F.length(c).isin(15, 18)


def fmt_number(c: Column) -> Column:
    """A double as text: whole values without a fraction, others in plain decimals."""
    plain = F.regexp_replace(F.format_string("%.10f", c), r"\.?0+$", "")
    return F.when(c == F.floor(c), F.format_string("%.0f", c)).otherwise(plain)


def cell_text(c: Column, kind: str, record_type: str | None = None) -> Column:
    """A cell as text: null is empty, a record shows its type in brackets."""
    if record_type is not None:
        return F.when(c.isNull(), "").otherwise(F.lit(f"[{record_type}]"))
    text = fmt_number(c) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(text, F.lit(""))


def simplify_url(c: Column) -> Column:
    """Without the query string; cut after ``/query/``; every run of 18 letters and digits becomes ``{id}``."""
    bare = F.split_part(c, F.lit("?"), F.lit(1))
    return F.regexp_replace(F.regexp_replace(bare, "(/query/).*$", "$1"), "[a-zA-Z0-9]{18}", "{id}")


def humanize(c: Column) -> Column:
    return F.regexp_replace(c, "([A-Z])", " $1")


#: Minutes in each unit, largest first.
UNITS = (("month", 43200), ("week", 10080), ("day", 1440), ("hour", 60), ("minute", 1))


def format_duration(minutes: Column, units: int = len(UNITS)) -> Column:
    """Rounded minutes in words, at most ``units`` of the units that are not zero."""
    left, parts = F.floor(minutes + 0.5), []
    for name, size in UNITS:
        n = F.floor(left / size)
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))))
        left = left - n * size
    words = F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, units), " ")
    return F.when(minutes < 1, "Less than a minute").otherwise(words)


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB with at most one decimal; zero is ``0 B``."""
    step = F.least(F.floor(F.log(1024.0, F.greatest(n, F.lit(1)))), F.lit(3))
    value = F.round(n / F.pow(F.lit(1024.0), step), 1)
    unit = F.element_at(F.array(F.lit("B"), F.lit("KB"), F.lit("MB"), F.lit("GB")), (step + 1).cast("int"))
    return F.when(n <= 0, "0 B").otherwise(F.concat(fmt_number(value), F.lit(" "), unit))


def parse_action(c: Column) -> Column:
    """``type · name`` of an operation split at its first slash or colon; ``-`` where there is none."""
    parts = F.split(c, "[/:]")
    pair = F.concat(F.get(parts, F.lit(0)), F.lit(" · "), F.get(parts, F.lit(1)))
    return F.when(F.coalesce(c, F.lit("")).isin("", "CODE_UNIT_STARTED"), "-").when(F.size(parts) > 1, pair).otherwise(c)


def api_name(c: Column, pascal: bool = False) -> Column:
    """A name of letters, digits and underscores from a label."""
    safe = F.regexp_replace(c, "[^a-zA-Z0-9]", "_")
    if not pascal:
        return F.regexp_replace(F.regexp_replace(safe, "_+", "_"), "^_|_$", "")
    words = F.split(F.regexp_replace(safe, "[\\s_]+", "_"), "_")
    rest = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), F.substr(w, F.lit(2))))
    return F.concat(F.get(words, F.lit(0)), F.array_join(rest, ""))


def convert_value(c: Column) -> Column:
    """(kind, text) of a typed cell: empty is null, booleans, numbers that print as they were read, else text."""
    number = F.try_to_number(c, F.lit("S999999999999999"))
    as_double = c.try_cast("double")
    numeric = as_double.isNotNull() & ((fmt_number(as_double) == c) | (number.cast("string") == c))
    kind = F.when(F.coalesce(c, F.lit("")) == "", "null").when(F.lower(c).isin("true", "false"), "boolean").when(numeric, "number").otherwise("string")
    return F.struct(kind.alias("kind"), F.when(kind == "boolean", F.lower(c)).when(kind != "null", c).alias("text"))


def mend_typos(c: Column) -> Column:
    """Query text with single commas, none before FROM, and single blanks; string literals stay as they are.

    The text is cut at its quotes, in one pass; what lies an even number of quotes before the end is outside literals.
    """
    def mended(part: Column) -> Column:
        for pattern, by in ((r",(?:\s*,)+", ","), (r"(?i),\s*(?=from\b)", " "), (r"\s+", " ")):
            part = F.regexp_replace(part, pattern, by)
        return part

    parts = F.split(c, "'")
    outside = lambda i: (F.size(parts) - i) % 2 == 1
    return F.trim(F.array_join(F.transform(parts, lambda x, i: F.when(outside(i), mended(x)).otherwise(x)), "'"))


def last_of_each(pairs: Column) -> Column:
    """(name, value) pairs as a map; of pairs with one name the last counts."""
    named = F.transform(pairs, lambda x: x["name"])
    return F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(F.reverse(named), x["name"]) == F.size(named) - i))


def headers_map(c: Column) -> Column:
    """``Name: value`` lines as a map; lines without a colon are dropped, and the last of repeated headers counts."""
    lines = F.filter(F.split(c, "\r?\n"), lambda x: F.instr(x, ":") > 1)
    return last_of_each(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("name"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value"))))


def extract_json(c: Column) -> Column:
    """The JSON in a reply: the whole text, a fenced block, or the outermost braces or brackets; null if none parses."""
    tries = [c, F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.regexp_extract(c, r"(?s)(\[.*\])", 1)]
    good = [F.when(F.length(t) > 0, F.to_json(F.try_parse_json(t))) for t in tries]
    return F.coalesce(*good)


def extract_tag(c: Column, tag: str) -> Column:
    return F.regexp_extract(c, f"<{tag}>(.*?)</{tag}>", 1)


def url_record_id(url: Column) -> Column:
    """A record id from an address: an ``id`` parameter, a lightning path, or a path that is an id alone."""
    tries = [F.regexp_extract(url, p, 1) for p in (r"[?&]id=([a-zA-Z0-9]{15,18})(?:&|#|$)", r"/r/\w+/([a-zA-Z0-9]{15,18})(?:/|$)", r"^\w+://[^/]+/([a-zA-Z0-9]{15,18})(?:[/?#]|$)")]
    return F.coalesce(*[F.when(is_record_id(t), t) for t in tries])


def url_object(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/lightning/[or]/(\w+)/", 1), F.lit(""))


def channel_label(c: Column) -> Column:
    """A channel's label: without its suffix, underscores as blanks."""
    return F.regexp_replace(F.regexp_replace(c, "(__e|__chn|ChangeEvent)$", ""), "_", " ")


def api_version(release: Column) -> Column:
    return (F.substring(release, 1, 3).cast("int") / 2 - 64).cast("int")


def developer_name(c: Column) -> Column:
    """Without the custom suffix and the namespace in front."""
    return F.regexp_replace(F.regexp_replace(c, "__c$", ""), "^.*__", "")


def plural(n: Column, suffix: str = "s") -> Column:
    return F.when(n == 1, "").otherwise(suffix)


def severity(c: Column) -> Column:
    """error, warning, info or note; anything else is info."""
    low = F.lower(c)
    known = F.when(low == "critical", "error").when(low == "information", "info").when(low.isin("error", "warning", "info", "note"), low)
    return F.coalesce(known, F.lit("info"))


def fault_message(errors: Column) -> Column:
    """``code: message [fields]`` of each error, joined by commas."""
    fields = lambda e: F.when(F.size(e["fields"]) > 0, F.concat(F.lit(" ["), F.array_join(e["fields"], ", "), F.lit("]"))).otherwise("")
    return F.array_join(F.transform(errors, lambda e: F.concat(e["code"], F.lit(": "), e["message"], fields(e))), ", ")


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.substring(w, 1, 1)), "")


def linear_color(count: Column, top: int = 50) -> Column:
    """A colour from green to red as the count goes from 1 to ``top``; empty for no positive count."""
    share = (F.least(F.greatest(count, F.lit(1)), F.lit(top)) - 1) / F.lit(top - 1.0)
    channel = lambda a, b: F.round(F.lit(float(a)) + share * (b - a)).cast("int")
    return F.when(count > 0, F.format_string("rgb(%d, %d, %d)", channel(46, 231), channel(204, 76), channel(113, 60))).otherwise("")


def random_value(key: Column, kind: str, seed: int, choices: Sequence[str] = ()) -> Column:
    """A value of a type from a hash of seed and key; types that are not generated are null, others get a made-up word."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    if kind in ("picklist", "multipicklist"):
        return F.get(F.array(*map(F.lit, choices or ("Unknown",))), (n % max(1, len(choices))).cast("int"))
    if kind in ("reference", "id", "address", "location"):
        return F.lit(None).cast("string")
    text = F.substr(digest, F.lit(1), (n % 15 + 5).cast("int"))
    made = {"boolean": n % 2 == 0, "int": n % 10000} | dict.fromkeys(("double", "currency", "percent"), F.round(n % 100000 / 100.0, 2))
    made |= dict.fromkeys(("string", "textarea", "longtextarea", "url", "email", "phone"), text)
    return made.get(kind, F.concat(F.lit("gen_"), F.substring(digest, 1, 8)))


def ttl_valid(written: Column, hours: Column, now: Column, default_hours: int = 168) -> Column:
    """Whether an entry is younger than its own hours, or else the default."""
    return F.unix_micros(now) - F.unix_micros(written) < F.coalesce(hours, F.lit(default_hours)) * 3_600_000_000


#: How the lines of a log name what was run.
UNIT = r"(?m)^\d+[^|]*\|CODE_UNIT_STARTED\|"
REMOTE = r"^VFRemote:\s*([A-Za-z0-9_]+)\s+invoke\(([A-Za-z0-9_]+)\)"
SIGNATURE = r"^([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\("
TRIGGER = r"(?i)^([A-Za-z0-9_]+)\s+on\s+[A-Za-z0-9_]+\s+trigger\s+event\s+([A-Za-z]+)$"
TRIGGER_EVENT = r"(?i)\s*trigger\s+event\s+([A-Za-z]+)"
NO_CLASS = ("TRIGGERS", "EXTERNAL")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _method(cls: Column, method: Column) -> Column:
    """``Class.method``; a method that is named as its class is the constructor."""
    return F.when(cls == method, F.concat(cls, F.lit(" (constructor)"))).otherwise(F.concat(cls, F.lit("."), method))


def _trigger(text: Column, name: Column) -> Column:
    """``Trigger · name (event)`` of a description; ``name`` stands in where the description has none."""
    rest = F.nullif(F.trim(F.regexp_replace(text, TRIGGER_EVENT, "")), F.lit(""))
    own = F.coalesce(_found(text, TRIGGER), rest, name)
    return F.concat(F.lit("Trigger · "), own, F.lit(" ("), F.coalesce(_found(text, TRIGGER, 2), _found(text, TRIGGER_EVENT)), F.lit(")"))


def derive_action(body: Column, operation: Column) -> Column:
    """What a log is about: the first stage that hits, or else the operation's own parts.

    The stages: a component action; the description behind a unit's id; a signature; a trigger; a class name; an
    entered method; what else the unit's fields say; the start of a flow. A null body has the operation's parts.
    """
    component = F.concat(_found(body, UNIT + r"[^|]*\|apex://(\w+)/ACTION\$(\w+)", 1), F.lit("."), _found(body, UNIT + r"[^|]*\|apex://(\w+)/ACTION\$(\w+)", 2))
    described = F.trim(_found(body, UNIT + r"[^|]*\|[0-9a-zA-Z]{15,18}\|(.+?)$"))
    remote = F.concat(F.lit("VFRemote · "), _found(described, REMOTE, 1), F.lit("."), _found(described, REMOTE, 2))
    free = F.when((described != "") & (described != "TRIGGERS") & ~described.startswith("["), described)
    signed = UNIT + r"[^|]*\|(?:[^|]*\|)?([A-Za-z0-9_]+)\.([A-Za-z0-9_]+)\([^)]*\)"
    path = r"(?im)" + UNIT[4:] + r"[^|]*\|[^|]*\|([^|\n]+?)\|__sfdc_trigger/([A-Za-z0-9_]+)"
    fired = _trigger(F.trim(_found(body, path, 1)), _found(body, path, 2))
    fired = F.coalesce(fired, F.concat(F.lit("Trigger · "), F.coalesce(_found(body, path, 2), _found(body, r"(?i)__sfdc_trigger/([A-Za-z0-9_]+)"))))
    cls = _found(body, UNIT + r"[^|]*\|(?:[^|]*\|)?([A-Za-z0-9_]+)(?:\||$)")
    entered = F.split(_found(body, r"\bMETHOD_ENTRY\|[^|]*\|[^|]*\|([A-Za-z0-9_.]+)\(.*?\)"), r"\.")
    entry = F.when(F.size(entered) > 1, _method(F.try_element_at(entered, F.lit(-2)), F.try_element_at(entered, F.lit(-1)))).otherwise(F.get(entered, F.lit(0)))
    return F.coalesce(
        component, remote, _method(_found(described, SIGNATURE, 1), _found(described, SIGNATURE, 2)), free, _method(_found(body, signed, 1), _found(body, signed, 2)),
        fired, F.when(~cls.isin(*NO_CLASS), cls), entry, F.when(body.rlike(UNIT + r"\[EXTERNAL\]\|execute_anonymous_apex"), "execute_anonymous_apex"), _unit_label(body),
        F.concat(F.lit("Flow · "), F.trim(_found(body, r"FLOW_(?:START|CREATE)_INTERVIEW[^|]*\|([^\n|]+)"))), parse_action(operation),
    )


def _unit_label(body: Column) -> Column:
    """A label from the fourth, or else the third, field of a unit: a trigger, a class path, a flow, or as it stands."""
    fourth = F.nullif(F.trim(_found(body, UNIT + r"[^|]*\|[^|]*\|([^|\n]+)")), F.lit(""))
    unit = F.coalesce(fourth, F.nullif(F.trim(_found(body, UNIT + r"[^|]*\|([^|\n]+)")), F.lit("")))
    parts = F.split(F.regexp_replace(unit, r"(?i)^Class[.:]", ""), r"\.")
    last, owner = F.try_element_at(parts, F.lit(-1)), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.get(parts, F.lit(0)))
    path = F.when((last != "") & (last != owner), F.concat(owner, F.lit("."), last)).otherwise(owner)
    flow = F.coalesce(F.nullif(F.get(F.split(unit, "[:.]"), F.lit(1)), F.lit("")), F.regexp_replace(unit, "(?i)^Flow[:.]?", ""))
    trigger = F.coalesce(_trigger(unit, F.lit("-")), F.concat(F.lit("Trigger · "), unit))
    return (
        F.when(unit.rlike(r"(?i)\btrigger\s+event\b"), trigger).when(unit.rlike(r"(?i)^Class[.:]"), path)
        .when(unit.rlike("(?i)^Flow"), F.concat(F.lit("Flow · "), flow)).otherwise(unit)
    )
