r"""PII: detected entities are replaced by keyed, type-consistent surrogates, with DataFrame functions only.

One pattern finds the entities of a text.  The corpus's distinct entities (kind and normal form) are gathered, and
each gets a surrogate from SHA-512 over key, kind, normal form and attempt: digits become digits, letters
letters of their case and script, card numbers keep their issuer digit and Luhn validity, phone numbers their
country code and layout, e-mail addresses their top-level domain and a common surrogate for a common domain, names after a
title the gender and script.  Collision rounds make the mapping one to one: of entities that drew the
same surrogate one keeps it, and a surrogate that is itself an entity of the corpus is not used; the others draw again.
The mapping is joined to the occurrences, so an entity has the same surrogate everywhere.

Texts without entities are not shuffled; of the others, occurrences (not texts) meet the mapping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_materialised, materialise

#: Titles by gender.
MALE = ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "господин", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Signora", "госпожа", "Госпожа"]
#: Titles of either gender; the surrogate is a name of either gender too.
EITHER = ["Dr", "Prof", "Professor", "Doctor", "Doctora", "доктор", "профессор"]
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + EITHER, key=len, reverse=True)) + r")\.? "
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SEP = "[ .-]?"
SSN = r"\d{3}-\d{2}-\d{4}(?![\d-])"
LOCAL = r"\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])"
#: What a space in a phone number may not lead into: an IP address, decimal or time, a date, SSN, local phone or cards in groups.
OTHER = rf"(?:\d+[.,:/]\d|\d{{4}}-\d\d-\d\d(?!\d)|{SSN}|{LOCAL}|(?:\d{{4}}(?:[ -]\d{{4}}){{2}}[ -]\d{{1,7}}(?!\d) ?)+(?![ -]?\d))"
#: A further group of digits; the strict one does not follow a group joined by dot or dash with a space.
GROUP = rf"(?:[.-]?\d{{2,4}}| (?!{OTHER})\d{{2,4}})"
STRICT = rf"(?:[.-]?\d{{2,4}}|(?<![.-]\d{{2,4}}) (?!{OTHER})\d{{2,4}})"
#: Country codes 1 and 7 have ten digits; others one or two groups more than the first two.
ABROAD = rf"\+[17]{SEP}(?:\(\d{{3}}\)|\d{{3}}){SEP}\d{{3}}{SEP}\d{{2}}{SEP}\d{{2}}(?!\d)|\+\d{{1,3}}{SEP}\(\d{{2,4}}\){SEP}\d{{2,4}}{SEP}\d{{2,4}}{STRICT}{{0,2}}(?!\d)|\+\d{{1,3}}{SEP}\d{{2,4}}{SEP}\d{{2,4}}(?:{GROUP}{STRICT}?)?(?!\d)"
#: Kinds in order of precedence; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|(?=[a-f0-9]*[a-f])(?=[a-f0-9]*[0-9])[0-9a-f]{32,128})(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": rf"{ABROAD}|(?<!\d)\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?!\d)|(?<![\d-]){LOCAL}",
    "ssn": rf"(?<![\d-]){SSN}",
    "card": r"(?<![\d.,])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\d])",
    "name": rf"(?<!\p{{L}}){TITLE}\p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity: all kinds but names and three secrets need a digit or an @.
HINT = rf"[0-9@]|{TITLE}|sk-|A[KS]IA|gh[pousr]_"

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYR_LOWER, CYR_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
#: Syllables for invented names: onset and core by script.
SYLLABLES = {"l": ["bel", "cor", "dal", "fen", "gar", "hol", "jas", "kel", "lor", "mar", "nev", "pol", "quin", "ros", "sel", "tam", "ul", "vel", "wil", "zan"], "c": ["бел", "вор", "гал", "дор", "жан", "зор", "кал", "лем", "мир", "нел", "пав", "рад", "сел", "тим", "фед", "яр"]}
ENDINGS = {"given_m:l": "o", "given_f:l": "a", "given_e:l": "i", "surname:l": "er", "given_m:c": "ан", "given_f:c": "а", "given_e:c": "и", "surname_m:c": "ов", "surname_f:c": "ова", "surname_e:c": "енко"}


def kind_of(m: str) -> str:
    """SQL: the kind of a found entity."""
    cases = " ".join(f"WHEN {m} rlike {quoted('^(?:' + p + ')$')} THEN '{k}'" for k, p in PATTERNS.items())
    return f"CASE {cases} ELSE 'card' END"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def components(m: Column) -> Column:
    """The entities of one occurrence: array of (kind, norm); a name has one for each part."""
    def one(k: str, norm: str) -> str:
        return f"array(named_struct('kind', {k}, 'norm', {norm}))"

    of = lambda titles: quoted("^(?:" + "|".join(titles) + r")\.? ")
    gender = f"CASE WHEN m rlike {of(FEMALE)} THEN 'f' WHEN m rlike {of(EITHER)} THEN 'e' ELSE 'm' END"
    script = r"CASE WHEN m rlike '\\p{IsCyrillic}+$' THEN 'c' ELSE 'l' END"
    parts = f"split(regexp_replace(m, {quoted('^' + TITLE)}, ''), ' ')"
    last = f"CASE WHEN {script} = 'c' THEN concat('surname_', {gender}, ':c') ELSE 'surname:l' END"
    names = f"transform({parts}, (p, i) -> named_struct('kind', CASE WHEN i = size({parts}) - 1 THEN {last} ELSE concat('given_', {gender}, ':', {script}) END, 'norm', lower(p)))"
    digits = "regexp_replace(m, '[^0-9]', '')"
    cc = "length(regexp_extract(m, '^.([0-9]{1,3})', 1))"
    sql = f"""CASE kind WHEN 'name' THEN {names}
        WHEN 'email' THEN {one("'email'", 'lower(m)')}
        WHEN 'secret' THEN {one("CASE WHEN m rlike '^[0-9a-f]+$' THEN 'hex' ELSE 'secret' END", 'm')}
        WHEN 'iban' THEN {one("'iban'", "replace(m, ' ', '')")}
        WHEN 'ip' THEN {one("'ip'", 'm')}
        WHEN 'phone' THEN {one(f"CASE WHEN m like '+%' THEN concat('phone:', {cc}) ELSE 'phone:0' END", digits)}
        ELSE {one('kind', digits)} END"""
    return F.expr(sql)


def luhn(digits: str) -> str:
    """SQL: the sum of Luhn's algorithm for digits that lack their check digit."""
    d = "cast(substring(z, length(z) - i + 1, 1) as int)"
    total = f"aggregate(sequence(1, length(z)), 0, (a, i) -> a + CASE WHEN i % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"
    return f"transform(array({digits}), z -> {total})[0]"


def drawn(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities (kind, norm) plus `sur`, the surrogate of this attempt: `kept`, then `text` with each letter or digit replaced by one of
    its class, as the bytes of a digest say (of the domain's own digest in an e-mail's host)."""
    def digest(what: str, salt: str) -> str:
        return f"sha2(concat_ws('|', {quoted(key)}, {what}, '{salt}'), 512)"

    cc = "cast(substring_index(kind, ':', -1) as int)"
    marks = "'^(AKIA|ASIA|gh[a-z]_|sk-)'"
    e = entities.withColumns({
        "h": F.expr(f"concat({digest('kind, norm', attempt)}, {digest('kind, norm', f'{attempt}+')})"),
        "domain": F.expr("substring_index(norm, '@', -1)"),
        "at": F.expr("CASE WHEN kind = 'email' THEN instr(norm, '@') ELSE 0 END"),
        "kept": F.expr(f"CASE WHEN kind = 'secret' THEN regexp_extract(norm, {marks}, 1) WHEN kind = 'iban' THEN substring(norm, 1, 2) WHEN kind = 'card' THEN substring(norm, 1, 1) WHEN kind like 'phone%' THEN substring(norm, 1, {cc}) ELSE '' END"),
    })
    e = e.withColumns({"dh": F.expr(f"concat({digest('domain', 'domain')}, {digest('domain', 'domain+')})"), "text": F.expr("substring(norm, length(kept) + 1)"), "last": F.expr(r"CASE WHEN at > 0 THEN length(norm) - length(regexp_extract(domain, '\\.[^.]*$', 0)) ELSE length(norm) END")})

    def pick(alphabet: str) -> str:
        return f"substring('{alphabet}', x.b % {len(alphabet)} + 1, 1)"

    byte = "cast(conv(substring(if(at > 0 AND i > at, dh, h), 2 * ((if(at > 0 AND i > at, i - at, i) - 1) % 128) + 1, 2), 16, 10) as int)"
    letters = f"WHEN x.c rlike '[0-9]' THEN {pick('0123456789')} WHEN x.c rlike '[a-z]' THEN {pick(LOWER)} WHEN x.c rlike '[A-Z]' THEN {pick(UPPER)} WHEN x.c rlike '[а-я]' THEN {pick(CYR_LOWER)} WHEN x.c rlike '[А-Я]' THEN {pick(CYR_UPPER)} WHEN x.c rlike '\\\\p{{Lu}}' THEN {pick(UPPER)} WHEN x.c rlike '\\\\p{{L}}' THEN {pick(LOWER)}"
    one = f"transform(array(named_struct('c', substring(text, i, 1), 'b', {byte})), x -> CASE WHEN i > last THEN x.c WHEN kind = 'hex' THEN CASE WHEN x.c rlike '[0-9a-f]' THEN {pick('0123456789abcdef')} ELSE x.c END {letters} ELSE x.c END)[0]"
    mapped = f"concat(kept, array_join(transform(sequence(1, greatest(length(text), 1)), i -> {one}), ''))"
    octets = ", '.', ".join(f"1 + (cast(conv(substring(h, {8 * i + 1}, 4), 16, 10) as int)) % 254" for i in range(4))

    def invented(script: str) -> str:
        table = "array(" + ", ".join(f"'{s}'" for s in SYLLABLES[script]) + ")"
        part = f"element_at({table}, cast(conv(substring(h, 2 * i - 1, 2), 16, 10) as int) % {len(SYLLABLES[script])} + 1)"
        return f"initcap(concat(array_join(transform(sequence(1, {3 + attempt // 2}), i -> {part}), ''), CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ENDINGS.items() if k.endswith(script)) + " END))"

    checked = f"transform(array({mapped}), y -> CASE WHEN kind <> 'card' OR ({luhn('substring(norm, 1, length(norm) - 1)')} + cast(right(norm, 1) as int)) % 10 <> 0 THEN y ELSE transform(array(substring(y, 1, length(y) - 1)), k -> concat(k, (10 - {luhn('k')} % 10) % 10))[0] END)[0]"
    sur = f"CASE WHEN kind = 'ip' THEN concat({octets}) WHEN kind like '%:c' THEN {invented('c')} WHEN kind like '%:l' THEN {invented('l')} ELSE {checked} END"
    return e.withColumn("sur", F.expr(sur)).select("kind", "norm", "sur")


def assign(entities: DataFrame, key: str, most_rounds: int = 40) -> DataFrame:
    """(kind, norm, sur) for distinct entities: one to one within a family of kinds.

    In the first eight rounds no surrogate may be an entity's normal form; later rounds, which only a
    crowded format needs, ask for distinctness alone (and never give an entity itself).  Invented names begin with three syllables and
    get one more every other round, so that they never run out."""
    family = F.substring_index("kind", ":", 1)
    entities = materialise(entities.distinct(), "pii-entities")
    real = entities.select(family.alias("f"), F.lower("norm").alias("s")).distinct()
    taken, pending, width = None, entities, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(most_rounds):
        # drawn in tasks of their own, however few bytes the entities are, and written, so that the joins do not draw again
        some = materialise(drawn(pending.repartition(width, "kind", "norm"), key, attempt), "pii-drawn")
        new = some.withColumn("f", family).withColumn("s", F.lower("sur")).where("s != lower(norm)")
        if attempt < 8:
            new = new.join(real, ["f", "s"], "left_anti")
        if taken is not None:
            new = new.join(taken.select("f", "s"), ["f", "s"], "left_anti")
        won = new.groupBy("f", "s").agg(F.min(F.struct("kind", "norm", "sur")).alias("w")).select("f", "s", "w.*")
        won = materialise(won, "pii-won")
        taken = won if taken is None else taken.unionByName(won)
        drop_materialised(some)
        left = materialise(pending.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti"), "pii-pending")
        if attempt:
            drop_materialised(pending)
        pending = left
        if not pending.take(1):
            return taken.select("kind", "norm", "sur")
    raise RuntimeError(f"{pending.count()} entities have no surrogate of their format after {most_rounds} rounds")


def laid_out() -> Column:
    """The replacement of an occurrence m from its components' surrogates s (array)."""
    char, index = "substring(m, i, 1)", "length(regexp_replace(substring(m, 1, i), '[^A-Za-z0-9]', ''))"
    spread = f"array_join(transform(sequence(1, length(m)), i -> CASE WHEN {char} rlike '[A-Za-z0-9]' THEN substring(s[0], {index}, 1) ELSE {char} END), '')"
    name = f"concat(regexp_extract(m, {quoted('^(' + TITLE + ')')}, 1), array_join(s, ' '))"
    return F.expr(f"""CASE WHEN kind = 'name' THEN CASE WHEN m = upper(m) THEN upper({name}) ELSE {name} END
        WHEN kind = 'email' AND m = upper(m) THEN upper(s[0]) WHEN kind IN ('email', 'secret', 'ip') THEN s[0] ELSE {spread} END""")


def surrogates(docs: DataFrame, key: str = "surrogate-key", text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """docs with every detected entity of the text replaced; with kinds_col also the array of kinds, in order.

    Texts without entities, null and empty texts come back as they are.  Repeated rows get equal results.
    An entity in two layouts has one surrogate in both; a name keeps its title, and
    each of its parts is an entity; where a text names a part again without a title, in the same letters (and over two of them), it
    is replaced there too (not in a stretch that holds the private character U+E000).  After a title without gender the surrogate
    has none, and so is another one than after Mr. or Mrs.  Columns may have any name that does not begin with `__pii`.
    """
    text = F.col(text_col)
    if kinds_col:
        docs = docs.drop(kinds_col)
    columns = docs.columns
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("__pii_found", F.coalesce(found, F.array().cast("array<string>")))
    none = marked.where("size(__pii_found) = 0").drop("__pii_found")
    some = marked.where("size(__pii_found) > 0").withColumn("__pii_row", F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary"))))
    some = materialise(some, "pii-texts")
    occ = some.select("__pii_row", F.posexplode("__pii_found").alias("p", "m")).distinct()
    occ = occ.withColumn("kind", F.expr(kind_of("m"))).withColumn("parts", components(F.col("m")))
    occ = occ.select("__pii_row", "p", "m", "kind", F.posexplode("parts").alias("q", "part")).select("__pii_row", "p", "m", F.col("kind").alias("k"), "q", F.col("part.kind").alias("kind"), F.col("part.norm").alias("norm"))
    mapping = assign(occ.select("kind", "norm"), key)
    met = occ.join(mapping, ["kind", "norm"])
    each = met.groupBy("__pii_row", "p", "m", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "sur"))), lambda x: x["sur"]).alias("s"))
    each = each.withColumnRenamed("k", "kind").withColumn("new", laid_out())
    bare = f"split(regexp_replace(m, {quoted('^' + TITLE)}, ''), ' ')"
    parts = F.expr(f"CASE WHEN kind = 'name' THEN transform({bare}, (x, i) -> named_struct('part', x, 'sur', CASE WHEN x = upper(x) THEN upper(s[i]) ELSE s[i] END)) ELSE array() END")
    lists = each.groupBy("__pii_row").agg(F.array_sort(F.collect_list(F.struct("p", "new", "kind"))).alias("__pii_new"), F.array_distinct(F.flatten(F.collect_list(parts))).alias("__pii_names"))
    back = some.join(lists, "__pii_row")
    # a name's parts are replaced where they stand without a title too, each place once: what has been put in is marked until the end
    again = r"aggregate(filter(__pii_names, n -> length(n.part) > 2), x, (t, n) -> if(not contains(t, n.part), t, regexp_replace(t, concat('(?<![\\p{L}\\p{N}\ue000])', n.part, '(?![\\p{L}\\p{N}])'), concat('\ue000', n.sur))))"
    pieces = F.split(text, ENTITY, -1)
    named = F.expr(f"transform(__pii_pieces, x -> CASE WHEN contains(x, '\ue000') THEN x ELSE replace({again}, '\ue000', '') END)")
    back = back.withColumn("__pii_pieces", pieces).withColumn("__pii_pieces", F.when(F.size("__pii_names") > 0, named).otherwise(F.col("__pii_pieces")))
    joined = F.expr("concat(__pii_pieces[0], array_join(transform(__pii_new, x -> concat(x.new, element_at(__pii_pieces, x.p + 2))), ''))")
    back = back.withColumn(text_col, joined)
    if kinds_col:
        back = back.withColumn(kinds_col, F.transform("__pii_new", lambda x: x["kind"]))
        none = none.withColumn(kinds_col, F.array().cast("array<string>"))
        columns = [*columns, kinds_col]
    return none.select(*columns).unionByName(back.select(*columns))
