"""The employee count that a page's JSON-LD states, read in the JVM as one expression.

Blocks are walked level by level: an aggregate holds the nodes of the current
level and the best statement so far, and takes as many steps as the deepest
block has levels.  Objects are read twice: as text, which keeps the order of
their keys, and as VARIANT, which tells the kind of each value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where blocks stand, what counts as an organisation, and the bounds of a count.
BLOCK = r"(?is)<script\b[^>]*type\s*=\s*[\x22\x27]application/ld\+json[\x22\x27][^>]*>(.*?)</script>"
ORGANIZATION, CORPORATION = "Organization", "Corporation"
LEAST, MOST = 1, 10_000_000

_STRICT = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"
_DECIMAL = r"^\\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\\s*$"
_NODE = "struct<place: array<int>, text: string, named: boolean>"
_FOUND = "struct<is_range: int, place: array<int>, low: bigint, high: bigint>"
_NUMBERS = "('BIG', 'DOU', 'DEC', 'FLO', 'INT')"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with `name` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _entries(text: str, named: str) -> str:
    """SQL: array of (key, text, kind) of the values of an object or array, in their order; kind is the start of the type's name."""

    def of(keys: str, texts: str, values: str) -> str:
        return f"zip_with({texts}, {values}, (e, v) -> named_struct('key', {keys}, 'text', {'e.value' if keys == 'e.key' else 'e'}, 'kind', substring(schema_of_variant(v), 1, 3)))"

    of_object = of("e.key", f"map_entries(from_json({text}, 'map<string,string>'))", f"map_values(from_json({text}, 'map<string,variant>'))")
    of_array = of("cast(null as string)", f"from_json({text}, 'array<string>')", f"from_json({text}, 'array<variant>')")
    return f"coalesce(if({named}, {of_object}, {of_array}), array())"


def _last(entries: str, key: str) -> str:
    return f"try_element_at(filter({entries}, z -> z.key = '{key}'), -1)"


def _one(value: str) -> str:
    return _let(value, "one", f"if(one between {LEAST} and {MOST}, named_struct('low', one, 'high', one), null)")


def _quantity(text: str) -> str:
    """SQL: the bounds that an object with minValue and maxValue, or with value, states."""
    whole = lambda e: f"cast(case when {e}.kind = 'BOO' then if({e}.text = 'true', 1D, 0D) when {e}.kind in ('STR', 'BIG', 'DOU', 'DEC', 'FLO', 'INT') and {e}.text rlike '{_DECIMAL}' then cast(trim({e}.text) as double) end as bigint)"
    given = lambda e: f"({e} is not null and {e}.kind <> 'VOI')"
    fields = f"named_struct('low', {_last('q', 'minValue')}, 'high', {_last('q', 'maxValue')}, 'value', {_last('q', 'value')})"
    read = (
        f"named_struct('both', {given('f.low')} and {given('f.high')}, 'low', {whole('f.low')}, 'high', {whole('f.high')},"
        f" 'value', if({given('f.value')}, {whole('f.value')}, null))"
    )
    bounds = (
        "case when r.both and (r.low is null or r.high is null) then null"
        f" when r.both and r.low > 0 and r.high >= r.low then named_struct('low', r.low, 'high', r.high) else {_one('r.value')} end"
    )
    return _let(_entries(text, "true"), "q", _let(fields, "f", _let(read, "r", bounds)))


def _bounds(entry: str) -> str:
    """SQL: struct(low, high) of a numberOfEmployees value, null where it is none."""
    digits = f"trim(replace({entry}.text, ',', ''))"
    return (
        f"case when {entry}.kind in {_NUMBERS} then {_one(f'cast(cast({entry}.text as double) as bigint)')}"
        f" when {entry}.kind = 'BOO' then {_one(f'''cast(if({entry}.text = 'true', 1, 0) as bigint)''')}"
        f" when {entry}.kind = 'STR' then {_one(f'''try_cast(if({digits} rlike '^[0-9]+$', {digits}, null) as bigint)''')}"
        f" when {entry}.kind = 'OBJ' then {_quantity(f'{entry}.text')} end"
    )


def _is_organization(entry: str) -> str:
    named = f"exists({_entries(f'{entry}.text', 'false')}, y -> y.kind = 'STR' and contains(y.text, '{ORGANIZATION}'))"
    return f"coalesce(case {entry}.kind when 'STR' then contains({entry}.text, '{ORGANIZATION}') or {entry}.text = '{CORPORATION}' when 'ARR' then {named} end, false)"


def _statement(entries: str, place: str) -> str:
    """SQL: what an object with these entries states, as _FOUND; null without a statement."""
    count = _last(entries, "numberOfEmployees")
    bounds = f"if({_is_organization('t')}, {_bounds('x')}, null)"
    made = f"if(b is null, null, named_struct('is_range', if(b.low = b.high, 0, 1), 'place', {place}, 'low', b.low, 'high', b.high))"
    return _let(count, "x", f"if(x is null, null, {_let(_last(entries, '@type'), 't', _let(bounds, 'b', made))})")


def _step() -> str:
    """SQL: from the nodes of one level to those of the next, with what they state."""
    opened = f"transform(s.nodes, n -> named_struct('place', n.place, 'named', n.named, 'entries', {_entries('n.text', 'n.named')}))"
    stated = f"transform(o, p -> if(p.named, cast({_statement('p.entries', 'p.place')} as {_FOUND}), null))"
    below = "filter(transform(p.entries, (e, i) -> named_struct('place', concat(p.place, array(i)), 'text', e.text, 'named', e.kind = 'OBJ', 'nested', e.kind in ('OBJ', 'ARR'))), c -> c.nested)"
    nodes = f"flatten(transform(o, p -> transform({below}, c -> named_struct('place', c.place, 'text', c.text, 'named', c.named))))"
    state = f"named_struct('nodes', cast({nodes} as array<{_NODE}>), 'found', cast(array_min(concat(array(s.found), {stated})) as {_FOUND}))"
    return _let(opened, "o", state)


def _depth(text: str) -> str:
    """SQL: how deep brackets nest outside strings."""
    bare = rf"""regexp_replace({text}, '"(?:[^"\\\\]|\\\\.)*+"', '')"""
    turn = "if(c in ('{', '['), 1, -1)"
    step = f"named_struct('now', d.now + {turn}, 'most', greatest(d.most, d.now + {turn}))"
    return f"aggregate(regexp_extract_all({bare}, '[\\\\[\\\\]{{}}]', 0), named_struct('now', 0, 'most', 0), (d, c) -> {step}, d -> d.most)"


def stated_employees(html: str) -> Column:
    """struct(value_min, value_point, value_max, kind) of the organisation's employee count in the JSON-LD of a column of pages, null without one.

    Organisation nodes at any depth of any block count, in the order of the
    page: the first exact count, else the first range (kind `bucket`).  A count
    is a number, digits (with commas), or an object with `minValue` and
    `maxValue`, or `value`; exact ones lie between LEAST and MOST.  Blocks that
    are no JSON, or repeat a key in an inner object, are passed over; of a key
    repeated in a node the last counts.
    """
    bodies = f"transform(regexp_extract_all(coalesce(`{html}`, ''), r'{BLOCK}', 1), b -> regexp_replace(b, '^\\\\s+|\\\\s+$', ''))"
    sound = f"size(coalesce(from_json(concat('[', b, ']'), 'array<string>', {_STRICT}), array())) = 1 and try_parse_json(b) is not null and b rlike '^[\\\\[{{]'"
    nodes = "filter(transform(blocks, (b, i) -> named_struct('place', array(i), 'text', b, 'named', startswith(b, '{'))), n -> n.text is not null)"
    levels = f"coalesce(array_max(transform(nodes, n -> {_depth('n.text')})), 0)"
    first = f"named_struct('nodes', cast(nodes as array<{_NODE}>), 'found', cast(null as {_FOUND}))"
    walk = f"aggregate(if({levels} > 0, sequence(1, {levels}), array()), {first}, (s, k) -> {_step()}, s -> s.found)"
    made = "if(w is null, null, named_struct('value_min', cast(w.low as double), 'value_point', (w.low + w.high) / 2D, 'value_max', cast(w.high as double), 'kind', if(w.is_range = 0, 'exact', 'bucket')))"
    read = _let(f"transform(bodies, b -> if({sound}, b, null))", "blocks", _let(nodes, "nodes", _let(walk, "w", made)))
    return F.expr(_let(bodies, "bodies", f"if(size(bodies) = 0, null, {read})"))
