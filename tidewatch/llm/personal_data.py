"""Personal data: fixed forms, and candidates that gradient-boosted trees judge.

Four fixed forms (the base: email, ip, card, phone) are found by pattern and check. Beside them, generators of high recall propose spans
of further forms (spelled-out addresses, numbers without a plus, cards next to each other, account numbers, secrets, ...), which overlap
freely: one number is proposed as a card, a phone and an id. Boosted trees score each proposal by its format (lengths, classes, groups, check
digits) and context (words and characters around it). A threshold of each kind, calibrated on planted examples that the trees haven't seen, selects;
selected spans that overlap merge into one, and what a base span covers falls away.

Texts carry no labels of spans, so the trees are fitted to examples planted into stretches of a bounded sample of documents: true forms, and
look-alikes that must stay. All work on documents is native expressions on one row at a time: nothing is shuffled. Offsets come from the lengths of the
pieces between matches; running sums and maxima go by chunks, so their cost grows as n^1.5 in a row's n spans at most.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .html_extract import Trees, boost

#: Order of kinds in a result: those of the base first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "mac", "secret", "ssn")

#: The base's patterns, written without backtracking: a match starts where a run of its first class starts, or where the last match ended.
#: Each has a cheap test that all texts with a match pass, and the check that a match must pass.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(t, '@')", "true"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"t RLIKE r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'", r"s RLIKE r'^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$'"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11,}+", r"t RLIKE r'[0-9](?:[\x20-]?[0-9]){11}'", "CASE WHEN length(d) <= 19 THEN {luhn} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"t RLIKE r'\+[0-9]'", "length(d) BETWEEN 9 AND 15"),
}

#: Sum of a number's digits for the Luhn check, over the string ``d``.
LUHN = "aggregate(sequence(1, length(d)), 0, (sum, i) -> sum + CASE WHEN (length(d) - i) % 2 = 0 THEN int(substr(d, i, 1)) ELSE int(substr('0246813579', int(substr(d, i, 1)) + 1, 1)) END) % 10 = 0"

_SECRET_CUE = r"(?:pass(?:word|wd|code|phrase)?|pwd|secret|api[_\x20-]?key|access[_\x20-]?key|token|bearer|auth)"
_AT, _DOT = r"(?:\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20(?:at|AT|@)\x20)", r"(?:\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20(?:dot|DOT)\x20|\.)"
#: Generators: the kinds that each proposes its matches as (with a condition on the match), its pattern, and the test that all texts with a match pass.
GENERATORS = (
    ({"card": "length(d) BETWEEN 12 AND 19", "phone": "length(d) BETWEEN 7 AND 15", "ssn": "length(d) = 9"}, r"(?<![0-9A-Za-z+_./-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,32}+(?![0-9A-Za-z_])", r"t RLIKE r'[0-9](?:[\x20()./-]{0,2}[0-9]){6}'"),
    ({"card": "length(d) BETWEEN 12 AND 19", "phone": "length(d) BETWEEN 9 AND 15"}, r"(?<![0-9A-Za-z_])[0-9]{9,19}+(?![0-9A-Za-z_])", r"t RLIKE r'[0-9]{9}'"),
    ({"email": "true"}, rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+{_AT}[A-Za-z0-9-]{{1,63}}+(?:{_DOT}[A-Za-z0-9-]{{1,63}}+){{1,4}}", r"t RLIKE r'[\x20\[({<](?:at|AT|@)[\x20\])}>]'"),
    ({"ip": "true"}, r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\x20?\.\x20?)[0-9]{1,3}){3}(?![0-9])", r"t RLIKE r'[0-9](?:[\[({](?:\.|dot)[\])}]|\x20\.|\.\x20)[0-9]'"),
    ({"iban": "true"}, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{1,4}+){3,8}+(?![A-Za-z0-9])", r"t RLIKE r'[A-Z]{2}[0-9]{2}[\x20-]?[A-Z0-9]{2}'"),
    ({"ip": "contains(s, ':')", "mac": "length(s) = 17"}, r"(?<![0-9A-Za-z:-])(?:[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{0,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}+)(?![0-9A-Za-z:-])", r"t RLIKE r'[:-][0-9A-Fa-f]{1,4}[:-]'"),
    ({"secret": "true"}, r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9+/_-]{10,}+){0,2}+={0,2}", r"t RLIKE r'[A-Za-z0-9+/_-]{16}'"),
    ({"secret": "true"}, rf"(?<=(?i:{_SECRET_CUE})[\x22\x27]?\x20{{0,2}}[:=]\x20{{0,2}}[\x22\x27]?)[^\x20\x09-\x0D\x22\x27]{{6,64}}+", rf"t RLIKE r'(?i){_SECRET_CUE}[\x22\x27]?\x20{{0,2}}[:=]'"),
)

#: Words in the 40 characters before a span, by the kind that they speak for; the last speak against all.
CUES = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|host|server|addr|from|login|client",
    "card": r"card|visa|master|amex|credit|debit|pay|\bcc\b",
    "phone": r"phone|tel\b|tel[.:]|call|fax|mobile|cell|whatsapp|text me|dial",
    "iban": r"iban|account|bank|transfer|bic",
    "mac": r"\bmac\b|device|hardware|adapter|wifi",
    "secret": _SECRET_CUE + r"[\x22\x27]?\x20{0,2}[:=]?\x20{0,2}[\x22\x27]?$",
    "ssn": r"ssn|social|security|tax id|tin\b",
    "none": r"order|invoice|isbn|issn|version|serial|part|sku|ref|commit|sha\d*|md5|hash|etag|page|article|date|build|release|item|lot|chapter|uuid|figure|total|score|ratio|\bat\b.*\bat\b",
}

#: Names and expressions of a proposal's features, over its kind, s (the span), d (its digits), before, after (characters around it).
FEATURES = {
    **{f"is_{k}": f"int(kind = '{k}')" for k in KINDS},
    **{f"cue_{k}": f"int(lower(before) RLIKE r'{p}')" for k, p in CUES.items()},
    "chars": "least(length(s), 80)",
    "digits": "least(length(d), 40)",
    "small": "least(length(regexp_replace(s, '[^a-z]', '')), 40)",
    "capitals": "least(length(regexp_replace(s, '[^A-Z]', '')), 40)",
    "others": "least(length(regexp_replace(s, '[0-9A-Za-z]', '')), 20)",
    "distinct": "least(size(array_distinct(split(left(s, 80), ''))), 30)",
    "groups": "least(size(split(s, '[^0-9A-Za-z]+')), 12)",
    "switches": "least(length(regexp_replace(regexp_replace(regexp_replace(left(s, 80), '[0-9]+', '9'), '[A-Za-z]+', 'a'), '[^9a]', '')), 20)",
    "first": "coalesce(try_cast(left(d, 1) AS int), -1)",
    "hex": "int(s RLIKE '^[0-9a-fA-F]+$')",
    "luhn": "int(CASE WHEN length(d) BETWEEN 12 AND 19 THEN {luhn} ELSE false END)",
    "mod97": "int(CASE WHEN kind = 'iban' THEN aggregate(split(regexp_replace(concat(substr(regexp_replace(s, '[^0-9A-Z]', ''), 5), left(s, 4)), '[^0-9A-Z]', ''), ''), 0, (m, c) -> CASE WHEN c RLIKE '^[0-9]$' THEN (m * 10 + int(c)) % 97 WHEN c = '' THEN m ELSE (m * 100 + ascii(c) - 55) % 97 END) = 1 ELSE false END)",
    "shape_324": "int(s RLIKE '^[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}$')",
    "shape_334": r"int(s RLIKE r'^\(?[0-9]{3}\)?[-.\x20]{1,2}[0-9]{3}[-.\x20][0-9]{4}$')",
    "trunk": r"int(s RLIKE r'^\(?0')",
    "year": r"int(s RLIKE r'(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])')",
    "month_day": r"int(s RLIKE r'(?<![0-9])[0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])')",
    "brackets": r"int(s RLIKE r'[\[\](){}<>]')",
    "dotted": r"int(s RLIKE r'\x20?[\[({<]?(?i:dot)[\])}>]?')",
    "byte_groups": r"int(s RLIKE r'^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:[^0-9]+|$)){4}$')",
    "long_words": "size(filter(split(s, '[^A-Za-z]+'), w -> length(w) > 6))",
    "doubled": "int(contains(s, '::'))",
    "wide": "size(filter(split(s, ':'), w -> length(w) > 2))",
    "known": "int(s RLIKE '^(AKIA|ASIA|ghp_|gho_|sk-|sk_|xox[bp]-|eyJ)')",
    "left_mark": r"CASE WHEN before = '' OR right(before, 1) RLIKE r'[\x20\x09-\x0D(]' THEN 0 WHEN right(before, 1) RLIKE r'[\x22\x27=:]' THEN 1 WHEN right(before, 1) RLIKE r'[#$/.]' THEN 2 ELSE 3 END",
    "right_mark": r"CASE WHEN after = '' OR left(after, 1) RLIKE r'[\x20\x09-\x0D,;.!?)]' THEN 0 WHEN left(after, 1) RLIKE r'[\x22\x27]' THEN 1 WHEN left(after, 1) RLIKE '[A-Za-z0-9]' THEN 2 ELSE 3 END",
}
#: Characters of context before and after a span, and of the chunks of running sums.
BEFORE, AFTER, CHUNK = 40, 4, 128


def bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` over the lambda variable ``name``, which holds ``value``, evaluated once: a column that is named inside a lambda may be evaluated for each element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, step: str) -> str:
    """SQL of the running result of ``step`` (over x and y, associative, with 0 as its unit) over an array of whole numbers >= 0, chunk by chunk."""
    over = lambda x, y: step.replace("{x}", x).replace("{y}", y)
    local = f"transform(transform(sequence(0, greatest(size(w) - 1, 0) div {CHUNK}), c -> slice(w, c * {CHUNK} + 1, {CHUNK})), k -> aggregate(k, cast(array() AS array<int>), (acc, v) -> concat(acc, array({over('coalesce(get(acc, size(acc) - 1), 0)', 'v')}))))"
    carried = f"aggregate(l, array(0), (acc, k) -> concat(acc, array({over('get(acc, size(acc) - 1)', 'coalesce(get(k, size(k) - 1), 0)')})))"
    joined = "flatten(transform(l, (k, i) -> transform(k, v -> " + over("v", "get(r, i)") + ")))"
    return bound("w", values, bound("l", local, bound("r", carried, joined)))


SUM, MOST = "({x} + {y})", "greatest({x}, {y})"


def _matches(rows: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` (with the text ``t``) and, for each name and (pattern, test), an array of (s, d, at, before, after); null where the test fails."""
    keep = rows.columns
    cut = rows.selectExpr("*", *(f"CASE WHEN {test} THEN split(t, r'{p}', -1) END AS _p_{k}" for k, (p, test) in patterns.items()))
    cut = cut.selectExpr("*", *(f"CASE WHEN size(_p_{k}) > 1 THEN regexp_extract_all(t, r'{p}', 0) END AS _m_{k}" for k, (p, _) in patterns.items()))
    lengths = "transform(z.m, (m, i) -> length(m) + length(get(z.p, i)))"
    placed = f"transform(z.m, (m, i) -> struct(m AS s, regexp_replace(m, '[^0-9]', '') AS d, get(e, i) - length(m) AS at, right(get(z.p, i), {BEFORE}) AS before, left(get(z.p, i + 1), {AFTER}) AS after))"
    return cut.selectExpr(*keep, *(f"CASE WHEN _m_{k} IS NOT NULL THEN {bound('z', f'struct(_m_{k} AS m, _p_{k} AS p)', bound('e', running(lengths, SUM), placed))} END AS {k}" for k in patterns))


def _over(name: str, expression: str) -> str:
    """An expression over s, d, kind, before, after as one over the fields of the lambda variable ``name``."""
    import re

    return re.sub(r"(r'[^']*'|'[^']*')|\b(?<![.(]c -> )(s|d|kind|before|after)\b(?!\()", lambda m: m[1] or f"{name}.{m[2]}", expression.replace("{luhn}", LUHN))


def base(rows: DataFrame) -> DataFrame:
    """``rows`` (with the text ``t``) and ``base_<kind>``: arrays of (kind, at, end) of the fixed forms."""
    found = _matches(rows, {f"_b_{k}": (p, test) for k, (p, test, _) in BASE.items()})
    made = (f"transform(filter(coalesce(_b_{k}, array()), x -> {_over('x', check)}), x -> struct('{k}' AS kind, x.at AS at, x.at + length(x.s) AS end)) AS base_{k}" for k, (_, _, check) in BASE.items())
    return found.selectExpr(*rows.columns, *made)


def proposals(rows: DataFrame) -> DataFrame:
    """``rows`` (with the text ``t``) and ``proposed``: an array of (kind, at, end, f), f the features by name."""
    found = _matches(rows, {f"_g_{i}": (p, test) for i, (_, p, test) in enumerate(GENERATORS)})
    as_kind = (f"transform(filter(coalesce(_g_{i}, array()), x -> {_over('x', when)}), x -> struct('{k}' AS kind, x.*))" for i, (kinds, _, _) in enumerate(GENERATORS) for k, when in kinds.items())
    as_kind = [x.replace("x.*", "x.s AS s, x.d AS d, x.at AS at, x.before AS before, x.after AS after") for x in as_kind]
    found = found.selectExpr(*rows.columns, f"flatten(array({', '.join(as_kind)})) AS _all")
    features = ", ".join(f"{_over('x', e)} AS {k}" for k, e in FEATURES.items())
    return found.selectExpr(*rows.columns, f"transform(_all, x -> struct(x.kind AS kind, x.at AS at, x.at + length(x.s) AS end, struct({features}) AS f)) AS proposed")


@dataclass
class Model:
    """Boosted trees over FEATURES, and for each kind the log-odds from which a proposal is selected (None: never)."""

    trees: Trees
    thresholds: dict[str, float | None]

    def odds(self, name: str) -> str:
        """SQL of the log-odds of a proposal, the lambda variable ``name``."""
        names = list(FEATURES)

        def node(tree: int, at: int) -> str:
            splits, leaves = self.trees.splits[tree], self.trees.leaves[tree]
            if at >= len(splits[0]):
                return repr(round(float(leaves[at - len(splits[0])]), 6)) + "D"
            left, limit = node(tree, 2 * at + 1), splits[1][at]
            if limit == float("inf"):
                return left
            right = node(tree, 2 * at + 2)
            return left if left == right else f"CASE WHEN {name}.f.{names[splits[0][at]]} > {limit} THEN {right} ELSE {left} END"

        return " + ".join([f"{self.trees.base!r}D", *(node(i, 0) for i in range(len(self.trees.splits)))])


# ---------------------------------------------------------------- planted examples


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _luhn_sum(digits: str) -> int:
    return sum(int(c) if i % 2 == 0 else int("0246813579"[int(c)]) for i, c in enumerate(reversed(digits)))


def _card(rng: random.Random, valid: bool = True) -> str:
    body = rng.choice(["4", "5" + rng.choice("12345"), "6011", "37"])
    body += _digits(rng, (14 if body == "37" else 15) - len(body))
    check = -_luhn_sum(body + "0") % 10
    return body + str((check if valid else check + rng.randrange(1, 10)) % 10)


def _parted(text: str, sizes, mark: str) -> str:
    parts, at = [], 0
    while at < len(text):
        size = sizes[min(len(parts), len(sizes) - 1)]
        parts.append(text[at : at + size])
        at += size
    return mark.join(parts)


def _iban(rng: random.Random, valid: bool = True) -> str:
    land, n, letters = rng.choice([("DE", 18, 0), ("GB", 14, 4), ("FR", 23, 0), ("ES", 20, 0), ("NL", 10, 4), ("IT", 22, 1)])
    bban = "".join(rng.choice("ABCDEFGHKLMNPRSTW") for _ in range(letters)) + _digits(rng, n)
    check = 98 - int("".join(str(int(c, 36)) for c in bban + land + "00")) % 97
    made = f"{land}{(check if valid else (check + rng.randrange(1, 90) - 2) % 97 + 2):02d}{bban}"
    return made if rng.random() < 0.5 else _parted(made, [4], " ")


def _chars(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


HEX, ALNUM = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _forms(rng: random.Random, words: list[str]) -> list[tuple[str | None, str, list[str], str]]:
    """One example of each form: its kind (None: a look-alike that must stay), text before it, the spans, text after it."""
    word = lambda: rng.choice(words).strip(".,;:!?()[]\"'").lower() or "so"
    plain = lambda: "".join(c for c in word() if c.isascii() and c.isalnum()) or "ann"
    pick, d = rng.choice, lambda n: _digits(rng, n)
    cue = lambda *own: pick(own + ("", "", "and "))
    nope = lambda: pick(["order ", "order no. ", "invoice ", "serial ", "part ", "item ", "ref ", "", ""])
    area = f"{rng.randrange(2, 10)}{d(2)}"
    mails = [(" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "."), (" (at) ", " (dot) "), (" AT ", " DOT "), (" at ", " dot "), (" @ ", "."), ("{at}", "{dot}")]
    at, dot = pick(mails)
    host = f"{pick([plain() + '.' if dot == '.' else '', ''])}{pick(['mail', 'example', plain()])}"
    tld = pick(["com", "org", "net", "de", "io", "fr", "es"])
    v4 = [str(rng.randrange(256)) for _ in range(4)]
    group = lambda: f"{rng.randrange(1, 65536):x}"
    year = f"{pick(['19', '20'])}{d(2)}"
    secret_cue = pick(["token", "password", "passwd", "secret", "api_key", "apikey", "API key", "access_key", "auth_token", "pwd"]) + pick([" = ", "=", ": ", ' = "', '="', ': "'])
    quote = '"' if secret_cue.endswith('"') else ""
    value = pick([_chars(rng, HEX, pick([16, 24, 32, 40])), _chars(rng, ALNUM, rng.randrange(10, 44)), _chars(rng, ALNUM + "!#%&*", rng.randrange(8, 20))])
    return [
        ("card", cue("card ", "visa: ", "pay with "), [_card(rng), _card(rng)], ""),
        ("card", cue("card ", "credit card "), [_parted(_card(rng), pick([[4], [4, 6, 5]]), pick([".", "/", "  ", " - "[:2]]))], ""),
        ("card", cue("card: ", "cc "), [_card(rng)], ""),
        (None, cue("card "), [_card(rng, False)], ""),
        (None, nope(), [d(1) + d(rng.randrange(11, 18)) if rng.random() < 0.3 else _card(rng, False)], ""),
        (None, pick(["isbn ", "ISBN: ", ""]), [f"978{d(10)}"], ""),
        (None, "", [f"{year}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}{rng.randrange(24):02d}{d(1)}0{d(1)}5"], ""),
        ("phone", cue("call ", "tel: ", "phone "), [pick([f"({area}) {d(3)}-{d(4)}", f"({area}) 555-{d(4)}", f"{area}-{d(3)}-{d(4)}", f"{area}.{d(3)}.{d(4)}", f"{area} {d(3)} {d(4)}"])], ""),
        ("phone", cue("call ", "tel. ", "mobile "), [pick([f"00{rng.randrange(20, 99)} {d(3)} {d(7)}", f"0{rng.randrange(10, 99)} {d(4)} {d(4)}", f"0{d(3)}/{d(7)}", f"0{d(4)} {d(6)}"])], ""),
        ("phone", pick(["call ", "phone: ", "fax ", "tel ", "cell: "]), [pick([f"0{d(9)}", f"{area}{d(7)}", f"{d(3)}-{d(4)}"])], ""),
        (None, cue("in ", "from "), [pick([f"{year}-{year}", f"{year}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(1, 29)}.{rng.randrange(1, 13)}.{year}", f"{rng.randrange(1, 29)}/{rng.randrange(1, 13)}/{year}"])], ""),
        (None, nope(), [pick([f"{d(2)}-{d(3)}-{d(3)}-{d(1)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}-{d(3)}-{d(3)}", f"{d(4)}-{d(5)}-{d(2)}"])], ""),
        (None, cue("of ", "total "), [pick([f"{rng.randrange(1, 10)} {d(3)} {d(3)} {d(3)}", f"{rng.randrange(1, 10)}.{d(3)}.{d(3)}.{d(3)}", f"{rng.randrange(1, 9)}.{d(9)}", d(rng.randrange(7, 11))])], ""),
        (None, cue("scores "), [" ".join(str(rng.randrange(1, 100)) for _ in range(rng.randrange(4, 9)))], ""),
        ("ssn", cue("ssn ", "SSN: ", "social security "), [f"{rng.randrange(1, 9)}{d(2)}-{d(2)}-{d(4)}"], ""),
        (None, pick(["part ", "serial ", "lot ", "sku "]), [f"{d(3)}-{d(2)}-{d(4)}"], ""),
        ("iban", cue("iban ", "IBAN: ", "transfer to ", "account "), [_iban(rng)], ""),
        (None, cue("model "), [_iban(rng, False)], ""),
        (None, cue("model ", "part "), [f"{_chars(rng, 'ABCDEFGHXZ', 2)}{d(2)}-{_chars(rng, 'ABCDEFXZ', 4)}-{d(4)}-{d(4)}"], ""),
        ("ip", cue("from ", "host "), [pick(["[.]", "(.)", "[dot]", "{.}"]).join(v4)], ""),
        ("ip", cue("from ", "client ", "address "), [pick([":".join(group() for _ in range(8)), f"2001:db8:{group()}::{group()}", f"fe80::{group()}:{group()}:{group()}:{group()}", f"2a0{d(1)}:{group()}:{group()}:{group()}::{rng.randrange(1, 10)}"])], ""),
        (None, cue("at ", "ratio "), [pick([f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", f"{rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}:{rng.randrange(30):02d}", ":".join(str(rng.randrange(1, 9)) for _ in range(rng.randrange(3, 6)))])], ""),
        (None, cue("items "), [pick([". ", " . "]).join(str(rng.randrange(1, 300)) for _ in range(4))], ""),
        ("mac", cue("mac ", "device "), [pick([":", "-"]).join(_chars(rng, HEX, 2) for _ in range(6))], ""),
        ("email", cue("mail ", "contact ", "write to "), [f"{plain()}{pick(['.', '_', ''])}{plain()}{pick(['', d(2)])}{at}{host}{dot}{tld}"], ""),
        (None, "", [f"{plain()} at {plain()}{pick([' dot ', '. '])}{plain()}" if rng.random() < 0.3 else f"{pick(['look', 'us', 'meet', 'held', plain()])} at {plain()}.{pick([plain(), 'com'])}"], ""),
        (None, "", [f"{plain()} @ {rng.randrange(1, 99)}.{d(2)}"], ""),
        ("secret", secret_cue, [value], quote),
        ("secret", pick(["token = \"", "secret: \"", "key = \""]), [_chars(rng, pick([HEX, ALNUM]), 40)], "\""),
        ("secret", cue("key ", "use "), [pick(["AKIA" + _chars(rng, ALNUM[:26] + "0123456789", 16), "ghp_" + _chars(rng, ALNUM, 36), "sk-" + _chars(rng, ALNUM, 40), f"eyJ{_chars(rng, ALNUM, 20)}.eyJ{_chars(rng, ALNUM, 30)}.{_chars(rng, ALNUM + '-_', 40)}"])], ""),
        (None, pick(["commit ", "sha1 ", "sha256: ", "md5 ", "hash ", "etag ", "checksum "]), [_chars(rng, HEX, pick([32, 40, 64]))], ""),
        (None, pick(["uuid ", "id ", ""]), ["-".join(_chars(rng, HEX, n) for n in (8, 4, 4, 4, 12))], ""),
        (None, cue("see ", "file "), [pick([f"{plain()}_{plain()}_{plain()}_{year}_final", f"/{plain()}/{plain()}/{plain()}/{plain()}", f"{plain().title()}{plain().title()}{plain().title()}{plain().title()}{plain().title()}", f"{plain()}-{plain()}-{plain()}-{plain()}-{plain()}"])], ""),
        (None, "", [pick("=-_+/ax0") * rng.randrange(16, 60)], ""),
        (None, "", ["".join(plain() for _ in range(6))], ""),
        (None, pick(["password: ", "the token: ", "pass: ", "secret: ", "auth: "]), [pick(["required", "optional", "missing", "changed", "see below"])], ""),
    ]


def planted(contexts: list[str], rng: random.Random, per_context: int) -> list[tuple[int, str, int, int, str | None]]:
    """(number of the context, text, start, end, kind or None) of examples planted into stretches of text; a row for each span."""
    words = [w for c in contexts for w in c.split() if len(w) < 15] or "here is some text to put things into".split()
    rows = []
    for number, context in enumerate(contexts):
        parts = context.split(" ")
        for kind, cue, spans, after in rng.sample(forms := _forms(rng, words), min(per_context, len(forms))):
            cut = rng.randrange(len(parts) + 1)
            text = " ".join([*parts[:cut], ""]) + cue
            places = []
            for span in spans:
                places.append((len(text), len(text) + len(span)))
                text += span + " "
            text = text[:-1] + after + rng.choice(["", "", ".", ",", "!!", "###"]) + " " + " ".join(parts[cut:])
            rows += [(number, text, *place, kind) for place in places]
    return rows


def fit(docs: DataFrame, column: str = "text", sample_docs: int = 240, per_context: int = 24, precision: float = 0.99, seed: int = 13) -> Model:
    """Trees fitted to planted examples, and thresholds that reach ``precision`` on planted examples that weren't fitted to.

    Contexts are stretches of 160 characters, at a place that a hash picks, of ``sample_docs`` documents: the least by the hash of their text, at
    most 10 rows a document sampled. Of each two contexts, one serves the fit and one the thresholds. Without documents the contexts are empty.
    """
    import numpy as np

    spark = docs.sparkSession
    text = text_of(docs, column)
    keyed = docs.select(F.xxhash64(text).alias("h"), text.alias("t")).where("t <> ''")
    stretches = keyed.select("h", F.substring("t", (F.pmod("h", F.greatest(F.length("t") - 160, F.lit(1))) + 1).cast("int"), F.lit(160)).alias("c"))
    contexts = [r.c for r in stretches.groupBy("h").agg(F.min("c").alias("c")).orderBy("h").limit(sample_docs).collect()] or [""] * 40
    rows = planted(contexts, random.Random(seed), per_context)
    texts = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row long, context int, t string, lo int, hi int, truth string")
    found = proposals(texts).select("context", "truth", "lo", "hi", F.explode("proposed").alias("p"))
    # A proposal counts where it meets the plant: as a hit if it is that span (but for two characters) and kind.
    found = found.where("p.at < hi AND p.end > lo").selectExpr("context", "p.kind AS kind", "coalesce(truth = p.kind AND abs(p.at - lo) + abs(p.end - hi) <= 2, false) AS hit", "truth = p.kind AS partly", "p.f.*")
    got = found.where("hit OR NOT coalesce(partly, false)").collect()
    x = np.array([[float(v) for v in r[4:]] for r in got])
    y = np.array([float(r.hit) for r in got])
    odd = np.array([r.context % 2 == 1 for r in got])
    kinds = np.array([r.kind for r in got])
    trees = boost(x[~odd], y[~odd], np.ones((~odd).sum()), trees=40)
    odds, thresholds = trees.odds(x), {}
    for kind in KINDS:
        own = odd & (kinds == kind)
        order = np.argsort(-odds[own], kind="stable")
        scores, hits = odds[own][order], y[own][order]
        share = (np.cumsum(hits) + 0.5) / (np.arange(len(hits)) + 1)
        good = np.flatnonzero(share >= precision)
        thresholds[kind] = max(float(scores[good[-1]]), 0.0) if len(good) and hits.any() else None
    return Model(trees, thresholds)


# ---------------------------------------------------------------- documents


def find(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs``' rows as ``_whole``, the text ``t``, ``base`` and ``spans``: arrays of (kind, at, end), sorted by place, then as KINDS lists them.

    Offsets count code points, the end is exclusive. ``spans`` holds the base and what the model selects.
    """
    rank = lambda x: f"CAST(array_position(array({', '.join(repr(k) for k in KINDS)}), {x}) AS int)"
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_whole"), text_of(docs, column).alias("t"))
    rows = proposals(base(rows))
    limits = " ".join(f"WHEN '{k}' THEN {'double(x.o) >= %r' % t if t is not None else 'false'}" for k, t in model.thresholds.items())
    rows = rows.selectExpr("*", f"transform(proposed, x -> struct(x.kind AS kind, x.at AS at, x.end AS end, {model.odds('x')} AS o)) AS _scored").drop("proposed")
    rows = rows.selectExpr("*", f"array_sort(transform(filter(_scored, x -> CASE x.kind {limits} ELSE false END), x -> struct(x.at AS at, x.end AS end, x.o AS o, x.kind AS kind))) AS _picked").drop("_scored")
    # Selected spans that overlap become one, of the kind that scores highest: a new one begins where none before reaches.
    rows = rows.selectExpr("*", f"CASE WHEN size(_picked) > 0 THEN {running('transform(_picked, x -> x.end)', MOST)} ELSE array() END AS _reach")
    edges = lambda spans: bound("z", f"struct({spans} AS s, _reach AS r)", "filter(sequence(0, size(z.s)), i -> i = 0 OR i = size(z.s) OR get(z.s, i).at >= get(z.r, i - 1))")
    rows = rows.selectExpr("*", f"{edges('_picked')} AS _cuts")
    best = "array_max(transform(slice(z.s, n + 1, get(z.c, j + 1) - n), y -> struct(y.o AS o, y.kind AS kind))).kind"
    rows = rows.selectExpr("*", f"CASE WHEN size(_picked) > 0 THEN {bound('z', 'struct(_picked AS s, _reach AS r, _cuts AS c)', f'transform(slice(z.c, 1, size(z.c) - 1), (n, j) -> struct({best} AS kind, get(z.s, n).at AS at, get(z.r, get(z.c, j + 1) - 1) AS end))')} ELSE array() END AS _merged")
    # In one order, base first among equals: a span falls away where the base before it reaches its end.
    order = f"struct(x.at AS at, 0 AS added, {rank('x.kind')} AS rank, x.end AS end, x.kind AS kind)"
    rows = rows.selectExpr("_whole", "t", f"array_sort(transform(concat({', '.join(f'base_{k}' for k in BASE_KINDS)}), x -> {order})) AS _base", f"transform(_merged, x -> {order.replace('0 AS added', '1 AS added')}) AS _more")
    rows = rows.selectExpr("*", "CASE WHEN size(_more) > 0 THEN array_sort(concat(_base, _more)) END AS _both")
    kept = bound("b", "_both", bound("o", running("transform(b, x -> CASE WHEN x.added = 0 THEN x.end ELSE 0 END)", MOST), "filter(b, (x, i) -> x.added = 0 OR get(o, i) < x.end)"))
    kept = f"array_sort(transform({kept}, x -> struct(x.at AS at, x.rank AS rank, x.end AS end, x.kind AS kind)))"
    plain = "x -> struct(x.kind AS kind, x.at AS at, x.end AS end)"
    return rows.selectExpr("_whole", "t", f"transform(_base, {plain}) AS base", f"CASE WHEN _both IS NULL THEN transform(_base, {plain}) ELSE transform({kept}, {plain}) END AS spans")


def written(spans: str) -> str:
    """SQL of spans as text: kind:start:end, joined by commas."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.at, x.end)), ',')"


def report(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans of each kind), base_sha256 (of the written base spans) and spans (all, written).

    A null or empty text has no spans; a very long one is searched whole. Repeated rows and ids are reported row by row, an empty table gives no
    rows, and other columns, whatever their names, are left out. Spans of different kinds may share characters; of two equal starts the kind first in KINDS comes first.
    """
    counts = (f"bigint(size(filter(base, x -> x.kind = '{k}'))) AS n_{k}" for k in BASE_KINDS)
    return find(docs, model, column).selectExpr("bigint(_whole.doc_id) AS doc_id", *counts, f"sha2({written('base')}, 256) AS base_sha256", f"{written('spans')} AS spans")


def redact(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in square brackets; spans that share characters become one, named after the first."""
    rows = find(docs, model, column).selectExpr("*", f"CASE WHEN size(spans) > 0 THEN {running('transform(spans, x -> x.end)', MOST)} ELSE array() END AS _reach")
    rows = rows.selectExpr("*", f"{bound('z', 'struct(spans AS s, _reach AS r)', 'filter(sequence(0, size(z.s)), i -> i = 0 OR i = size(z.s) OR get(z.s, i).at >= get(z.r, i - 1))')} AS _cuts")
    body = "transform(slice(z.c, 1, size(z.c) - 1), (n, j) -> concat('[', get(z.s, n).kind, ']', substr(z.t, get(z.r, get(z.c, j + 1) - 1) + 1, coalesce(get(z.s, get(z.c, j + 1)).at, length(z.t)) - get(z.r, get(z.c, j + 1) - 1))))"
    parts = bound("z", "struct(spans AS s, _reach AS r, _cuts AS c, t AS t)", body)
    text = f"CASE WHEN size(spans) > 0 THEN concat(left(t, get(spans, 0).at), array_join({parts}, '')) ELSE _whole.`{column}` END"
    return rows.selectExpr(*(f"{text} AS `{c}`" if c == column else f"_whole.`{c}`" for c in docs.columns))
