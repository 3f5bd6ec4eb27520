"""Canonical JSON text (T5) by scanning a document's tokens.

A VARIANT forgets the order of keys and the spelling of numbers, so the text
that ``json.dumps(json.loads(s), indent=2, ensure_ascii=False)`` gives is made
from the document's own text: scalars are spelt anew where they need it, regexes take
the white space and cut the lines, and one fold over the lines indents them.  Only a
document with a repeated key goes by its tokens and the container of each.
Everything is built-in functions, written as SQL text: the expression has
hundreds of nodes, which SQL makes in one call.

- Keys keep their order; of equal keys in one object the last value takes the
  first one's place.
- Escapes are decoded and written anew: only quotes, backslashes and control
  characters stay escaped.  Half a surrogate pair, which no UTF-8 text can
  hold, keeps its escape.
- Whole numbers keep every digit.  Others print as Python prints the double:
  decimals of up to 15 digits are exact by themselves; beyond that the digits
  are Java's (the shortest ones from Java 19 on).
- ``NaN``, ``Infinity`` and ``-Infinity`` stay as they are, as in Python.

The input must be one valid document (see ``jsoncheck.document_of``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# possessive repetition: long strings cost no stack
STRING = r'"(?:[^"\\]++|\\.)*+"'
TOKEN = STRING + r'|[{}\[\]:,]|[^\s{}\[\]:,"]++'
# pieces that together are the whole text, whether it is valid or not
PIECE = r"(?s)" + STRING + r'|-?Infinity|NaN|[^"NI-]++|.'
# what one escape, or a run without escapes, looks like
STRING_PIECE = r"(?s)\\u[dD][89abAB]..\\u[dD][c-fC-F]..|\\u....|\\.|[^\\]++"
NOT_NUMBERS = "('NaN', 'Infinity', '-Infinity')"
SHORT_ESCAPES = {8: r"\b", 9: r"\t", 10: r"\n", 12: r"\f", 13: r"\r", 34: r'\"', 92: r"\\"}
RUN = 128  # tokens in a run
# what fills a line of the canonical text, in a text without white space but for one space after a key
LINE = rf'(?:(?:{STRING}: )?+(?:\[\]|\{{\}}|[{{\[]|{STRING}|[^{{}}\[\]:,"]++)|[}}\]]),?'
LINES = 64  # lines in a run
OPENS, CLOSES = "IN ('{', '[')", "IN ('}', ']')"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row (usable inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def _let(name: str, value: str, body: str) -> str:
    """The same as SQL: ``body`` with ``name`` for ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _nulls_for_not_numbers(text: str) -> str:
    swapped = f"transform(regexp_extract_all({text}, r'{PIECE}', 0), p -> CASE WHEN p IN {NOT_NUMBERS} THEN ' null ' ELSE p END)"
    return f"CASE WHEN contains({text}, 'NaN') OR contains({text}, 'Infinity') THEN array_join({swapped}, '') ELSE {text} END"


def nulls_for_not_numbers(text: str) -> Column:
    """The text of a column with ``NaN`` and infinities outside strings as ``null``.

    Python's parser takes these, a VARIANT has no such numbers; the spaces keep
    the null from joining its neighbours into something valid.
    """
    return F.expr(_nulls_for_not_numbers(text))


def tokens(text: str) -> str:
    """Strings, punctuation, numbers and words of a valid document, in order."""
    return f"regexp_extract_all({text}, r'{TOKEN}', 0)"


def places(toks: str) -> str:
    """Per token: ``c``, the index of the bracket that opens its container (a
    bracket's own container is the one it opens or closes), and the depth ``d``
    after it.

    A fold copies what it has gathered at every step, so nothing long is
    gathered: tokens are taken in runs, each run says how many open brackets it
    closes and which it leaves open, the brackets open at each run's start follow
    from the runs before, and each run is folded from there.
    """
    none, place = "cast(array() AS array<int>)", "array<struct<c:int,d:int>>"
    stack = f"CASE WHEN t {OPENS} THEN array_append(a.open, a.i) WHEN t {CLOSES} AND size(a.open) > 0 THEN slice(a.open, 1, size(a.open) - 1) ELSE a.open END"
    outer = f"CASE WHEN t {CLOSES} AND size(a.open) = 0 THEN 1 ELSE 0 END"  # opened before the run
    effect = (f"aggregate(run, named_struct('i', r * {RUN}, 'closed', 0, 'open', {none}), "
              f"(a, t) -> named_struct('i', a.i + 1, 'closed', a.closed + {outer}, 'open', {stack}))")
    starts = (f"aggregate(transform(runs, (run, r) -> {effect}), array({none}), "
              "(s, e) -> array_append(s, concat(slice(element_at(s, -1), 1, size(element_at(s, -1)) - e.closed), e.open)))")
    own = f"CASE WHEN t {OPENS} THEN a.i WHEN size(a.open) > 0 THEN element_at(a.open, -1) ELSE -1 END"
    depth = f"size(a.open) + CASE WHEN t {OPENS} THEN 1 WHEN t {CLOSES} THEN -1 ELSE 0 END"
    placed = (f"aggregate(run, named_struct('i', r * {RUN}, 'open', get(starts, r), 'out', cast(array() AS {place})), "
              f"(a, t) -> named_struct('i', a.i + 1, 'open', {stack}, 'out', array_append(a.out, named_struct('c', {own}, 'd', {depth}))), a -> a.out)")
    last = f"greatest(cast(floor((size({toks}) - 1) / {RUN}) AS int), 0)"
    runs = f"transform(sequence(0, {last}), r -> slice({toks}, r * {RUN} + 1, {RUN}))"
    return _let("runs", runs, _let("starts", starts, f"flatten(transform(runs, (run, r) -> {placed}))"))


def string_text(t: str) -> str:
    """A string token with only the necessary escapes."""
    short = " ".join(f"WHEN {c} THEN r'{e}'" for c, e in SHORT_ESCAPES.items())
    other = (r"CASE WHEN code < 32 THEN concat(r'\u00', lower(lpad(hex(code), 2, '0'))) WHEN code BETWEEN 55296 AND 57343 THEN lower(p) "
             "ELSE decode(unhex(substring(p, 3, 4)), 'UTF-16BE') END")
    single = _let("code", "cast(conv(substring(p, 3, 4), 16, 10) AS int)", f"CASE code {short} ELSE {other} END")
    piece = (r"CASE WHEN NOT startswith(p, r'\') THEN p WHEN p = r'\/' THEN '/' WHEN length(p) = 2 THEN p "
             f"WHEN length(p) = 12 THEN decode(unhex(concat(substring(p, 3, 4), substring(p, 9, 4))), 'UTF-16BE') ELSE {single} END")
    return rf"CASE WHEN contains({t}, r'\') THEN array_join(transform(regexp_extract_all({t}, r'{STRING_PIECE}', 0), p -> {piece}), '') ELSE {t} END"


def _float_text(decimal: str) -> str:
    """Python's spelling of a decimal (digits, point, exponent in any form)."""
    parts = _let("s", f"split(lower(regexp_replace({decimal}, '^-', '')), 'e')",
                 "named_struct('whole', split_part(get(s, 0), '.', 1), 'part', split_part(get(s, 0), '.', 2), 'exp', coalesce(cast(get(s, 1) AS int), 0))")
    digits = _let("w", "concat(v.whole, v.part)", "named_struct('n', regexp_replace(regexp_replace(w, '^0+', ''), '0+$', ''), "
                  "'point', length(v.whole) + v.exp - length(w) + length(regexp_replace(w, '^0+', '')))")
    power = ("concat(substring(x.n, 1, 1), CASE WHEN length(x.n) > 1 THEN concat('.', substring(x.n, 2)) ELSE '' END, "
             "CASE WHEN x.point < 1 THEN 'e-' ELSE 'e+' END, CASE WHEN abs(x.point - 1) < 10 THEN '0' ELSE '' END, cast(abs(x.point - 1) AS string))")
    printed = (f"CASE WHEN x.n = '' THEN '0.0' WHEN x.point > 16 OR x.point < -3 THEN {power} "
               "WHEN x.point <= 0 THEN concat('0.', repeat('0', -x.point), x.n) "
               "WHEN x.point < length(x.n) THEN concat(substring(x.n, 1, x.point), '.', substring(x.n, x.point + 1)) "
               "ELSE concat(rpad(x.n, x.point, '0'), '.0') END")
    return f"concat(CASE WHEN startswith({decimal}, '-') THEN '-' ELSE '' END, {_let('v', parts, _let('x', digits, printed))})"


def number_text(t: str) -> str:
    """A number token as Python prints its value."""
    mantissa = f"regexp_replace(regexp_replace(regexp_replace({t}, '[eE].*$', ''), '[-.]', ''), '^0+', '')"
    from_double = ("CASE WHEN y = double('Infinity') THEN 'Infinity' WHEN y = double('-Infinity') THEN '-Infinity' "
                   "ELSE replace(cast(y AS string), '4.9E-324', '5E-324') END")  # the least of all
    text = _let("d", f"CASE WHEN length({mantissa}) <= 15 AND NOT rlike({t}, '[eE][-+]?[0-9]{{3,}}') THEN {t} ELSE {_let('y', f'cast({t} AS double)', from_double)} END",
                f"CASE WHEN d IN {NOT_NUMBERS} THEN d ELSE {_float_text('d')} END")
    return f"CASE WHEN NOT rlike({t}, '[.eE]') THEN CASE WHEN {t} = '-0' THEN '0' ELSE {t} END ELSE {text} END"


def scalar_text(t: str) -> str:
    return (f"CASE WHEN startswith({t}, '\"') THEN {string_text(t)} WHEN {t} IN ('true', 'false', 'null') OR {t} IN {NOT_NUMBERS} THEN {t} "
            f"ELSE {number_text(t)} END")


def _keys(toks: str, at: str) -> str:
    """Per token: the key's text after its container's index; NULL where the token is no key."""
    return (f"transform({toks}, (k, i) -> CASE WHEN get({toks}, i + 1) = ':' AND startswith(k, '\"') "
            f"THEN concat(cast(get({at}, i).c AS string), {string_text('k')}) END)")


def _merged(toks: str) -> str:
    """The tokens with the first repeated key's value moved to where the key stood first."""
    def end(p: str) -> str:  # what follows the value of the key at p
        return f"get(filter(sequence({p} + 2, size({toks}) - 1), j -> get(spot, j).c = get(spot, {p}).c AND get({toks}, j) IN (',', '}}')), 0)"

    again = "filter(sequence(0, size(keys) - 1), i -> get(keys, i) IS NOT NULL AND array_position(keys, get(keys, i)) <= i)"
    first = "cast(array_position(keys, get(keys, n)) - 1 AS int)"
    parts = (f"concat(slice({toks}, 1, e.at + 2), slice({toks}, n + 3, e.last - n - 2), "
             f"slice({toks}, e.first + 1, n - 1 - e.first), slice({toks}, e.last + 1, size({toks})))")
    moved = _let("f", first, _let("e", f"named_struct('at', f, 'first', {end('f')}, 'last', {end('n')})", parts))
    return _let("spot", places(toks), _let("keys", _keys(toks, "spot"), _let("n", f"get({again}, 0)", f"CASE WHEN n IS NULL THEN {toks} ELSE {moved} END")))


def repeated_keys(toks: str, at: str) -> str:
    """How many keys repeat another one of their object."""
    return _let("ks", f"filter({_keys(toks, at)}, k -> k IS NOT NULL)", "size(ks) - size(array_distinct(ks))")


def _n_keys(text: str) -> str:
    """How many keys a document's text has: colons outside its strings."""
    return _let("bare", f"regexp_replace({text}, r'{STRING}', '')", "length(bare) - length(translate(bare, ':', ''))")


def _without_repeats(text: str) -> str:
    """The text as it is, or where keys repeat its tokens with the last value of each in the first one's place."""
    merged = f"array_join(aggregate(sequence(1, number), tk, (acc, step) -> {_merged('acc')}), '')"
    return _let("tk", tokens(text), _let("number", _let("at", places("tk"), repeated_keys("tk", "at")), f"CASE WHEN number = 0 THEN {text} ELSE {merged} END"))


def _with_scalars(text: str) -> str:
    """The text with every string and number as Python spells it."""
    spelt = f"array_join(transform({tokens(text)}, t -> CASE WHEN length(t) = 1 THEN t ELSE {scalar_text('t')} END), '')"
    odd_number = f"rlike(regexp_replace({text}, r'{STRING}', ''), '[0-9][.eE]|-0')"
    return rf"CASE WHEN contains({text}, r'\') OR {odd_number} THEN {spelt} ELSE {text} END"


def printed(text: str) -> str:
    """A document's text, its scalars as they are, with a line for each scalar and
    bracket and two spaces of indentation a level.

    Regexes take the white space and cut the lines; one fold over these counts the
    brackets left open.  A fold copies what it has gathered at every step: lines are
    taken in runs, each from the depth at which the runs before it end.
    """
    bare = rf"regexp_replace({text}, r'({STRING})|\s++', '$1')"
    # every match begins where the last one ended, never inside a string
    spaced = rf"regexp_replace({bare}, r'\G((?:[^\":]++|{STRING})*+):', '$1: ')"
    closes, opens = "CASE WHEN left(l, 1) IN (']', '}') THEN 1 ELSE 0 END", "CASE WHEN right(l, 1) IN ('[', '{') THEN 1 ELSE 0 END"
    starts = (f"aggregate(slice(runs, 1, size(runs) - 1), array(0), "
              f"(s, run) -> array_append(s, aggregate(run, element_at(s, -1), (d, l) -> d + {opens} - {closes})))")
    step = f"named_struct('d', a.d + {opens} - {closes}, 'out', concat(a.out, '\\n', repeat('  ', a.d - {closes}), l))"
    text_of_run = f"aggregate(run, named_struct('d', get(starts, r), 'out', ''), (a, l) -> {step}, a -> a.out)"
    runs = f"transform(sequence(0, cast(floor((size(ls) - 1) / {LINES}) AS int)), r -> slice(ls, r * {LINES} + 1, {LINES}))"
    whole = _let("runs", runs, _let("starts", starts, f"array_join(transform(runs, (run, r) -> {text_of_run}), '')"))
    return f"substring({_let('ls', f"regexp_extract_all({spaced}, r'{LINE}', 0)", whole)}, 2)"


def canonical_text(text: str, document: str | None = None) -> Column:
    """T5: the canonical text of a column (by name) of valid documents (NULL stays NULL).

    ``document`` names the column of the parsed documents, where there is one.  A
    VARIANT keeps one of equal keys: tokens are compared only where it has not as many
    keys as the text, or cannot be made.
    """
    parsed = document or f"try_parse_json({_nulls_for_not_numbers(text)})"
    once = f"CASE WHEN {_n_keys(text)} <=> {_let('js', f'to_json({parsed})', _n_keys('js'))} THEN {text} ELSE {_without_repeats(text)} END"
    whole = _let("one", once, _let("spelt", _with_scalars("one"), printed("spelt")))
    return F.expr(f"CASE WHEN {text} IS NOT NULL THEN {whole} END")
