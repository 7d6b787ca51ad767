"""Surrogates for personal data, in SQL functions only.

Entities are found by one alternation and replaced where they stand.  A
surrogate is a keyed permutation of the entity's own characters: its letters and
digits are split in two halves, and three times one half is shifted, character
by character and each within its own alphabet (digits, lower or upper case of
one script), by a stream drawn from the key and the other half.  Every round can
be undone, so a step is: three rounds, the next string (the first two characters
counted up like an odometer), the three rounds undone.  Steps run in cycles of at
most ``CYCLE`` strings.  An entity walks along its cycle to the first string of
its own class (``_class``: a valid phone number or not, a secret of hexadecimal
digits or not, a word with the same ending, no leading zero in a group of an
address).  Each class is permuted in itself, and so

* different entities of a kind, as they are written, never share a surrogate
  (distinctness holds for any number of entities, without a table of them),
* the same entity has the same surrogate in every document, in any letter case
  and with any separators (coreference),
* length, separators, case and script stay (format), and no entity stays itself
  unless all others of its cycle are of another class, or none of its characters
  is in ``ALPHABETS``.

The calling code of phone numbers, the country of account numbers, the first digit of
cards and top-level domains stay; check digits of cards and account numbers are set
so that they hold if they held before.  Addresses stay valid.  Given names are
exchanged within their list (same gender and script), family names keep vowels,
consonants and endings that mark gender.

``checked`` holds the result against this: over the whole table no two entities
may share a surrogate and no entity may have two, or the operator fails.
"""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from .common import stored

KEY = "surrogates-1"

# Alphabets within which characters are exchanged.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX = ("0123456789abcdef", "0123456789ABCDEF")
NAME_ALPHABETS = (
    "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *ALPHABETS[3:5],
    "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", *ALPHABETS[7:9],
)

#: Strings of the longest cycle: two characters of the longest alphabet.
CYCLE = max(map(len, ALPHABETS)) ** 2
ROUNDS = 3

# Given names by gender and script, in no particular order.
GIVEN = {
    "female": "Anna Maria Elena Laura Julia Sophie Emma Sarah Claire Alice Marie Camille Lucia Carmen Isabel Marta Katharina Ursula Sabine Emily Olivia Jessica Jennifer Elizabeth Margaret Susan Linda Patricia Barbara Catherine Priya Fatima Aisha Yuki Ingrid Olga Teresa Chloe Amelia Hannah Helen Nancy Karen Lisa Michelle".split(),
    "male": "John James Robert Michael William David Richard Thomas Peter Paul Daniel Martin Hans Jürgen Klaus Stefan Pierre Jean Luc François Antoine Carlos José Miguel Javier Pablo Andrew George Edward Matthew Barack Mohammed Ahmed Omar Rajesh Hiroshi Joseph Charles Steven Kevin Brian Donald Ronald Anthony Luis Pedro Diego Marco Giovanni Piotr Lars Erik".split(),
    "female_cyrillic": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    "male_cyrillic": "Иван Пётр Сергей Алексей Дмитрий Андрей Николай Михаил Владимир Павел".split(),
}
TITLES = "Mr Mrs Ms Miss Dr Prof Professor Doctor President Senator Judge Captain Sir Lady Herr Frau Mme Mlle Monsieur Madame Señor Señora".split()
ENDINGS = "ова ева ина ская ов ев ин ский ova eva ska ski".split()
# What stands before or after a name.
BEFORE = "my name is|his name is|her name is|is named|is called|signed by|written by|reported by|posted by|name:|author:|contact:|from:|signed:|dear|regards,|sincerely,".split("|")
AFTER = "said says wrote writes told replied asked explained added announced".split()
# Calling codes of one and two digits; all others have three.
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

_ANY_GIVEN = "|".join(n for names in GIVEN.values() for n in names)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_ASSIGNED = r"(?i:(?<![\p{L}\p{N}])(?:token|secret|passwd|password|api[_-]?key)\s{0,3}[=:]\s{0,3}[\x22']?)"
_GROUP = "[0-9a-fA-F]{1,4}"
_LOCAL = r"[2-9]\d{2}[2-9]\d{6}"  # a valid number of ten digits

#: Kinds in order of precedence, with Java patterns.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "assigned": _ASSIGNED + r"(?=[^\s\x22',;]*\d)[^\s\x22',;]{6,}",
    "hex": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"(?:(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?<![\p{L}\p{N}(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}"
    rf"|(?<![\p{{L}}\p{{N}}+.,$€£#_/-])[2-9]\d{{9}}(?![.,_/-]?[\p{{L}}\p{{N}}]))(?!\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "ipv4": rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:])(?=[a-fA-F:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:)(?![\p{{L}}\p{{N}}:])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}}[\p{{L}}.-]*+ \p{{Lu}}\p{{Ll}})(?:(?:{'|'.join(TITLES)})\.? {_NAME}(?: {_NAME})?|(?:{_ANY_GIVEN}) {_NAME}"
    rf"|(?<=(?i:{'|'.join(BEFORE)}) ){_NAME} {_NAME}|{_NAME} {_NAME}(?= (?:{'|'.join(AFTER)})(?![\p{{L}}])))(?![\p{{L}}\p{{N}}])",
}


def _pattern() -> str:
    """All kinds as one alternation that is tried at the starts of words only, and by first character."""
    k = KINDS
    by_first = [
        k["email"], rf"(?=[tTsSpPaA]){k['assigned']}", rf"(?=[0-9a-fA-F])(?:{k['hex']}|{k['ipv6']})", rf"(?=[\d+(])(?:{k['phone']}|{k['ssn']}|{k['card']}|{k['ipv4']})",
        rf"(?=[Agsh]){k['key']}", rf"(?=[A-Z][A-Z]\d\d){k['iban']}", rf"(?=\p{{Lu}}\p{{Ll}}){k['name']}",
    ]
    return rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(by_first)})"


PATTERN = _pattern()


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values) -> str:
    return f"array({', '.join(map(_q, values))})"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


# In the SQL below: kd kind, ev entity, hd head that stays, fm form that is permuted, tl tail, al the alphabets between bars.


def _turned(char: str, by: str) -> str:
    """SQL for a character shifted within its alphabet; other characters stay."""
    upto, rest = "substring_index(substr(al, 1, ap), '|', -1)", "substring_index(substr(al, ap + 1), '|', 1)"
    shifted = _let("au", upto, _let("aw", f"concat(au, {rest})", f"substr(aw, cast(pmod(length(au) - 1 + {by}, length(aw)) as int) + 1, 1)"))
    return _let("ap", f"instr(al, {char})", f"if(ap = 0, {char}, {shifted})")


def _round() -> str:
    """SQL for round ``op`` of a step on the state st (x, y: arrays of characters): one half is shifted by a stream drawn from the other."""
    byte = "cast(conv(substr(ks, cast(pmod(ci + 1, 64) as int) * 2 + 1, 2), 16, 10) as int)"
    new = _let("ks", "sha2(concat(sl, mr, lower(array_join(kh, ''))), 512)", f"transform(sr, (cc, ci) -> {_turned('cc', f'sg * {byte}')})")
    out = _let("nh", new, f"if(op < {ROUNDS}, struct(st.y as x, nh as y), struct(nh as x, st.x as y))")
    mark = f"concat(cast(if(op < {ROUNDS}, op, {2 * ROUNDS} - op) as string), ':')"
    for name, value in (("mr", mark), ("sg", f"if(op < {ROUNDS}, 1, -1)"), ("kh", f"if(op < {ROUNDS}, st.y, st.x)"), ("sr", f"if(op < {ROUNDS}, st.x, st.y)")):
        out = _let(name, value, out)
    return out


def _next() -> str:
    """SQL for the state st (x, y) with its first two characters of an alphabet counted up."""
    again = "if(substr(al, instr(al, n1) - 1, 1) = '|', array_position(slice(ok, p1 + 1, size(ok)), true), 0)"
    counted = f"transform(wh, (cc, ci) -> if(ci + 1 = p1, n1, if(p2 > 0 and ci + 1 = p1 + p2, {_turned('cc', '1')}, cc)))"
    out = _let("co", counted, "struct(slice(co, size(st.y) + 1, size(st.x)) as x, slice(co, 1, size(st.y)) as y)")
    out = _let("n1", _turned("element_at(wh, p1)", "1"), _let("p2", again, out))
    out = _let("p1", "cast(array_position(ok, true) as int)", f"if(p1 = 0, st, {out})")
    return _let("wh", "concat(st.y, st.x)", _let("ok", "transform(wh, cc -> instr(al, cc) > 0)", out))


def _step(form: str) -> str:
    """SQL for the next form along the cycle.  Work and memory follow the form's length."""
    ops = f"aggregate(sequence(0, {2 * ROUNDS}), struct(slice(pv, 1, size(pv) div 2) as x, slice(pv, size(pv) div 2 + 1, size(pv)) as y), (st, op) -> if(op = {ROUNDS}, {_next()}, {_round()}), st -> concat(st.x, st.y))"
    chars = f"filter(split({_plain(form)}, ''), cc -> cc <> '')"
    return _filled(form, _let("pv", chars, f"if(size(pv) = 0, pv, {ops})"))


def _plain(value: str) -> str:
    return rf"regexp_replace({value}, '[^\\p{{L}}\\p{{N}}]', '')"


def _filled(form: str, letters: str) -> str:
    """SQL that puts an array of characters where ``form`` has letters and digits."""
    return rf"array_join(zip_with(split({form}, '[\\p{{L}}\\p{{N}}]', -1), {letters}, (sp, lc) -> concat(sp, coalesce(lc, ''))), '')"


def _ending(word: str) -> str:
    return rf"regexp_extract({word}, '^.{{2,}}?({'|'.join(ENDINGS)})$', 1)"


def _class(form: str) -> str:
    """SQL for what a surrogate's form has in common with the entity's."""
    listed = _list(TITLES + [n for names in GIVEN.values() for n in names])
    return (
        f"case kd when 'name' then {_let('nw', f'concat({form}, tl)', f'''concat(cast(array_contains({listed}, nw) as string), {_ending('nw')})''')}"
        f" when 'assigned' then case when {form} rlike '^[0-9a-f]+$' then 'h' when {form} rlike '^[0-9A-F]+$' then 'H' else '' end"
        rf" when 'phone' then {_let('dg', rf'''regexp_replace({form}, '[^0-9]', '')''', f'''concat(cast(dg rlike {_q(f'^{_LOCAL}$')} as string), cast(dg like '0%' as string))''')}"
        rf" when 'ipv6' then cast({form} rlike '(^|[:~])0' as string) else '' end"
    )


def _walked() -> str:
    """SQL for the first form after ``fm`` along its cycle that has its class."""
    step = _let("nx", _step("wk.w"), f"struct(nx as w, {_class('nx')} <=> c0 as d)")
    return _let("c0", _class("fm"), f"aggregate(sequence(1, {CYCLE}), struct(fm as w, false as d), (wk, ws) -> if(wk.d, wk, {step}), wk -> wk.w)")


def _check_digit(digits: str) -> str:
    """SQL for the check digit (mod 10, every second digit doubled) that follows ``digits``."""
    d = "cast(substr(rv, di, 1) as int)"
    total = f"aggregate(sequence(1, length(rv)), 0, (acc, di) -> acc + if(di % 2 = 1, {d} * 2 - if({d} > 4, 9, 0), {d}))"
    return _let("rv", f"reverse({digits})", f"pmod(10 - pmod({total}, 10), 10)")


def _account_digits(account: str) -> str:
    """SQL for the two check digits (mod 97) of an account number, by its country in ``hd`` and the rest of it."""
    c = "substr(rv, di, 1)"
    total = f"aggregate(sequence(1, length(rv)), 0, (acc, di) -> if({c} between '0' and '9', (acc * 10 + ascii({c}) - 48) % 97, (acc * 100 + ascii({c}) - 55) % 97))"
    return _let("rv", f"concat({_plain(account)}, substr(hd, 1, 2))", f"98 - ({total} * 100) % 97")


def _ipv4(value: str, key: str) -> str:
    def mixed(x: str, y: str, i: int) -> str:
        return f"({x} ^ cast(conv(substr(sha2(concat({_q(f'{key}:ipv4:{i}:')}, cast({y} as string)), 256), 1, 4), 16, 10) as int))"

    o = [f"cast(oc[{i}] as int)" for i in range(4)]
    joined = "concat_ws('.', cast(i3 div 256 as string), cast(i3 % 256 as string), cast(i2 div 256 as string), cast(i2 % 256 as string))"
    return _let("oc", rf"split({value}, '[.]')", _let("ir", f"{o[2]} * 256 + {o[3]}", _let("i1", mixed(f"({o[0]} * 256 + {o[1]})", "ir", 0),
        _let("i2", mixed("ir", "i1", 1), _let("i3", mixed("i1", "i2", 2), joined)))))


def _given(word: str, key: str) -> str:
    """SQL for a listed given name's surrogate, the title itself, or null."""
    pairs = [x for t in TITLES for x in (t, t, t + ".", t + ".")]
    for group, names in GIVEN.items():
        order = list(names)
        random.Random(int(hashlib.sha256(f"{key}:{group}".encode()).hexdigest(), 16)).shuffle(order)
        pairs += [x for pair in zip(order, order[1:] + order[:1], strict=True) for x in pair]  # one cycle: no name stays itself
    return f"element_at(map({', '.join(map(_q, pairs))}), {word})"


def kind_of(value: str) -> str:
    """SQL for an entity's kind; what is no other kind is a name, as its surroundings may say."""
    return "case " + " ".join(f"when {value} rlike {_q('^(?:' + p + ')$')} then '{k}'" for k, p in KINDS.items() if k != "name") + " else 'name' end"


def surrogate(value: str, key: str = KEY) -> str:
    """SQL for the surrogate of one entity (a SQL expression of its text)."""
    head = (
        rf"case kd when 'assigned' then regexp_extract(tk, {_q('^' + _ASSIGNED)}, 0) when 'key' then substr(tk, 1, 4) when 'iban' then substr(tk, 1, 4)"
        rf" when 'card' then substr(tk, 1, 1) when 'phone' then regexp_extract(tk, {_q(r'^\+' + CALLING)}, 0) else '' end"
    )
    tail = f"case kd when 'card' then substr(tk, -1) when 'email' then regexp_extract(tk, '[.][A-Za-z]+$', 0) when 'name' then {_ending('tk')} else '' end"
    form = r"substr(tk, length(hd) + 1, length(tk) - length(hd) - length(tl))"
    # Zeros that lead a group of an address don't take part.
    form = rf"if(kd = 'ipv6', regexp_replace(lower(tk), '(?<=(^|:)0{{0,3}})0', '~'), {form})"
    mode = "case when kd = 'name' then 4 when kd = 'ipv6' or kd in ('hex', 'assigned') and fm rlike '^[0-9a-f]+$' then 2 when kd in ('hex', 'assigned') and fm rlike '^[0-9A-F]+$' then 3 else 1 end"
    sets = _list("|" + "|".join(a) + "|" for a in (ALPHABETS, HEX[:1], HEX[1:], NAME_ALPHABETS))
    card = _let("cd", _check_digit(_plain("concat(hd, nf)")), f"concat(hd, nf, cast(pmod(cd + cast(tl as int) - {_check_digit(_plain('concat(hd, fm)'))}, 10) as string))")
    account = f"concat(substr(hd, 1, 2), lpad(cast(pmod({_account_digits('nf')} + cast(substr(hd, 3, 2) as int) - {_account_digits('fm')}, 100) as string), 2, '0'), nf)"
    made = f"case kd when 'card' then {card} when 'iban' then {account} when 'ipv6' then translate(nf, '~', '0') else concat(hd, nf, tl) end"
    for name, sql in (("nf", _walked()), ("sl", f"concat({_q(key + ':')}, kd, ':')"), ("al", f"element_at({sets}, {mode})"), ("fm", form), ("tl", tail), ("hd", head)):
        made = _let(name, sql, made)
    fixed = f"case when kd = 'name' then {_given('tk', key)} when kd = 'ipv4' then {_ipv4('tk', key)} end"
    each = f"transform(if(kd = 'name', split(ev, ' '), array(ev)), tk -> coalesce({fixed}, {made}))"
    return _let("ev", value, _let("kd", kind_of("ev"), f"array_join({each}, ' ')"))


def _pairs(found: str, key: str) -> str:
    """SQL for (entity, surrogate) of each of an array of entities."""
    return f"transform({found}, e -> struct(e as entity, {surrogate('e', key)} as surrogate))"


def _put(text: str, pairs: str) -> str:
    """SQL for a text with every entity replaced, and unchanged texts as they are."""
    parts = f"zip_with(split({text}, {_q(PATTERN)}, -1), {pairs}, (p, s) -> concat(p, coalesce(s.surrogate, '')))"
    return f"case when size({pairs}) > 0 then array_join({parts}, '') else {text} end"


def _found(text: str) -> str:
    return f"regexp_extract_all({text}, {_q(PATTERN)}, 0)"


def _norm(kind: str, value: str) -> str:
    """SQL for what is one entity: numbers and names in any letter case and with any separators, addresses as they are."""
    return rf"case when {kind} in ('phone', 'ssn', 'card', 'iban', 'name') then lower({_plain(value)}) when {kind} in ('email', 'ipv6') then lower({value}) else {value} end"


def checked(pairs: DataFrame) -> None:
    """Fails if, over all rows of (entity, surrogate), entities of a kind share a surrogate or one entity has two."""
    kind = F.expr(kind_of("entity"))
    rows = pairs.withColumn("kind", kind).selectExpr("kind", f"{_norm('kind', 'entity')} as e", f"{_norm('kind', 'surrogate')} as s")
    rows = rows.selectExpr("kind", "xxhash64(e) as e1", "hash(e) as e2", "xxhash64(s) as s1", "hash(s) as s2")
    for a, b in (("e", "s"), ("s", "e")):  # by entity its surrogates, by surrogate its entities
        by = rows.groupBy("kind", f"{a}1", f"{a}2").agg(F.min(f"{b}1").alias("lo"), F.max(f"{b}1").alias("hi")).where("lo <> hi")
        bad = by.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()
        if bad:
            raise ValueError(f"{'entities with two surrogates' if a == 'e' else 'surrogates of two entities'}: {[tuple(r) for r in bad]}")


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay, also ``n_chars`` if it is the text's length.

    Null and empty texts stay; repeated rows get equal results; an empty table
    gives no rows.  The result is written once, ``checked``, and read.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.expr(f"coalesce({_found('text')}, array())").alias("found"))
    rows = rows.withColumn("pairs", F.expr(_pairs("found", key))).withColumn("new", F.expr(_put(names["text"], "pairs")))
    if "n_chars" in names:
        n, old = names["n_chars"], F.length(names["text"])
        rows = rows.withColumn(n, F.when(F.col(n) == old, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)))
    void = {n for c, n in names.items() if isinstance(docs.schema[c].dataType, NullType)}  # can't be written
    kept = stored(rows.drop(names["text"], "found", *void))
    checked(kept.select(F.explode("pairs").alias("p")).select("p.*"))
    return kept.select(*(F.col("new" if c == "text" else n).alias(c) if n not in void else F.lit(None).alias(c) for c, n in names.items()))


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, text with surrogates and n_entities of every row of ``docs`` (doc_id, text).

    Null texts stay null with 0 entities; repeated rows get equal results; an
    empty table gives no rows; other columns are not read.  The result is written
    once, ``checked``, and read.
    """
    rows = docs.select("doc_id", F.col("text").alias("__text")).withColumn("pairs", F.expr(_pairs(f"coalesce({_found('__text')}, array())", key)))
    kept = stored(rows.select("doc_id", F.expr(_put("__text", "pairs")).alias("text"), "pairs"))
    checked(kept.select(F.explode("pairs").alias("p")).select("p.*"))
    return kept.selectExpr("doc_id", "text", "cast(size(pairs) as bigint) as n_entities")


def entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, kind, entity, surrogate) for every entity found; null texts have none, repeated rows repeat, an empty table gives no rows."""
    rows = docs.select("doc_id", F.explode(F.expr(_found("text"))).alias("entity"))
    return rows.selectExpr("doc_id", f"{kind_of('entity')} as kind", "entity", f"{surrogate('entity', key)} as surrogate")


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """By kind: entities, surrogates, surrogates of more than one entity (0 by construction) and entities left as they are.

    What is one entity is as in ``checked``; tables without entities give no rows.
    """
    pairs = entities(docs, key).selectExpr("kind", f"{_norm('kind', 'entity')} as entity", f"{_norm('kind', 'surrogate')} as surrogate").distinct()
    by = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("entity") == F.col("surrogate")).cast("long")).alias("same"))
    return by.groupBy("kind").agg(F.sum("n").alias("entities"), F.count(F.lit(1)).alias("surrogates"), F.sum((F.col("n") > 1).cast("long")).alias("collisions"), F.sum("same").alias("unchanged"))
