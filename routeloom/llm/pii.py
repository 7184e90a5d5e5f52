"""Surrogates for personal data, in DataFrames alone.

One pattern finds the entities of a text: mail and network addresses, telephone, card,
social security and account numbers, access keys, secrets after their labels, and names
after a title.  Each distinct entity gets one surrogate in the whole table, made from a
keyed hash (SHA-256), of the same type, script, case and format: digits stay digits and
letters stay letters of their alphabet, card numbers keep the state of their check digit,
addresses stay valid, and names keep the gender of their titles and their script.

Names are replaced word by word, so that a person has one identity in every form: the
words of a name found after a title are also replaced wherever else they stand in that
text, with or without a title, alone or together, in capitals or not.  A word that comes
first in a name of several words is a first name, of the gender that all its titles tell
(neutral if they differ or tell none); any other is a family name.

Collision checks go over all entities of the table: a surrogate that another entity of
the type has, or that is itself an entity of the table, is made again with the next
attempt, so that different entities stay different and no original returns.  Numbers are
told apart by their digits and mail addresses and names without regard to case, so all
spellings of one entity get the same surrogate in their own format.  Where no character
can change, or no attempt finds a free value, a placeholder with type and keyed hash
stands instead.

Texts are rebuilt from the parts between the entities, so a surrogate is never searched
again.  Only texts with entities are written and joined; the others pass in one scan.

Defined results: a null or empty text passes; an entity of a null id is replaced as any
other; repeated rows give repeated results; an empty table gives no rows; other columns
pass through, but for ``n_entities`` (the places where the pattern fits), which is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Titles with the gender they tell, in several languages.
TITLES = {
    "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|Don|Господин|Г-н",
    "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Госпожа|Г-жа",
    "x": "Dr|Prof|Mx",
}
#: First and family names by script and gender.
FIRST = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Henry Ivan Jonas Karl Lucas Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("latin", "f"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nina Olivia Paula Rosa Sofia Teresa Vera",
    ("latin", "x"): "Alex Ariel Casey Charlie Dana Eden Jamie Jordan Kim Lee Morgan Noel Quinn Robin Sam Sasha Sky Taylor Toni Val",
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей Тимур",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Инна Ксения Лидия Мария Нина Ольга Полина Римма Софья Юлия",
    ("cyrillic", "x"): "Валя Женя Саша Слава Шура Паша Миша Никита",
}
FAMILY = {
    "latin": "Abel Baker Conrad Dorn Ellis Frost Graf Hall Irving Jansen Keller Lang Moreau Novak Olsen Perez Reed Stein Turner Vidal Weber Young",
    "cyrillic": "Абрамов Белов Волков Громов Дубов Ершов Зимин Ильин Комаров Лебедев Морозов Носов Орлов Панов Рыбин Соколов",
}
SYLLABLES = {"latin": "ba de fi go lu ma ne ri so tu va we", "cyrillic": "ба де фи го лу ма не ри со ту ва зе"}
_TITLE = "|".join(TITLES.values())
NAME = r"\p{Lu}[\p{L}]+(?:[ -]\p{Lu}[\p{L}]+){0,2}"
#: In order: the first that fits at a place is the entity's type.
TYPES = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<=(?i:password|passwd|secret|token|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[^\s\"']{6,}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])",
    "name": rf"(?<=(?<![\p{{L}}])(?:{_TITLE})[.]{{0,1}}[ ]){NAME}",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: A text without any of this has no entity.
HINT = rf"[0-9@]|A[KS]IA[A-Z0-9]{{16}}|[=:][ ]{{0,2}}[\"']?[^\s\"']{{6}}|(?:{_TITLE})[.]? \p{{Lu}}"
#: Alphabets within which letters and digits are replaced.
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "äöüéèêçñóíáúâî", "ÄÖÜÉÈÊÇÑÓÍÁÚÂÎ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
MAX_ATTEMPTS = 40
PLACEHOLDER = "<"
#: A value without any of these has no surrogate alike.
CHANGEABLE = "[" + "".join(ALPHABETS) + "]"
SCRIPTS = {"cyrillic": r"^\p{IsCyrillic}+$", "latin": r"^\p{IsLatin}+$"}
#: Marks the entities of a text, and shields both marks where a text has them itself.
MARK, SHIELD = "\x01", "\x02"


def entities(text: Column) -> Column:
    """The entities of a text in order; none without a hint of one."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(HINT), found).otherwise(F.array().cast("array<string>"))


def marked(text: Column) -> Column:
    """The text with each entity between two marks."""
    has = F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(SHIELD))
    safe = F.replace(F.replace(text, F.lit(SHIELD), F.lit(SHIELD + "?")), F.lit(MARK), F.lit(SHIELD + "!"))
    text = F.when(has, safe).otherwise(text)
    return F.when(text.rlike(HINT), F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}")).otherwise(text)


def unshielded(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(SHIELD + "!"), F.lit(MARK)), F.lit(SHIELD + "?"), F.lit(SHIELD))


def type_of(entity: Column, before: Column) -> Column:
    """The type of an entity that follows ``before``; a secret or name is told by its label."""
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    out = F.when(whole(TYPES["mail"]), "mail").when(whole(TYPES["key"]), "key")
    out = out.when(before.rlike(r"(?i)(?:password|passwd|secret|token|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1}$"), "secret")
    for name in ("account", "address", "social", "card", "phone"):
        out = out.when(whole(TYPES[name]), name)
    for gender, titles in TITLES.items():
        out = out.when(before.rlike(rf"(?<![\p{{L}}])(?:{titles})[.]? $"), f"name-{gender}")
    return out.otherwise("secret")


def kinds_of(parts: Column, words: Column | None = None) -> Column:
    """The types of a text's entities, which are every second part; those among ``words`` are names."""

    def kind(i: Column) -> Column:
        entity = F.get(parts, 2 * i + 1)
        told = type_of(entity, F.right(F.get(parts, 2 * i), F.lit(32)))
        return told if words is None else F.when(F.array_contains(words, entity), "name").otherwise(told)

    n = (F.size(parts) - 1) / 2
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), kind)).otherwise(F.array().cast("array<string>"))


def split_names(hits: DataFrame) -> DataFrame:
    """From ``__pii_parts`` to parts in which every word of a detected name is an entity, with ``__pii_kinds`` and ``__pii_names``.

    ``__pii_names`` has the words of the detected names: word, first (of several) and gender.
    """
    hits = hits.withColumn("__pii_kinds", kinds_of(F.col("__pii_parts")))
    named = F.transform("__pii_kinds", lambda k, i: F.when(k.startswith("name"), F.struct(F.split(F.get("__pii_parts", 2 * i + 1), "[ -]").alias("words"), F.right(k, F.lit(1)).alias("gender"))))
    word = lambda n: F.transform(n["words"], lambda w, j: F.struct(w.alias("word"), ((j == 0) & (F.size(n["words"]) > 1)).alias("first"), n["gender"].alias("gender")))
    hits = hits.withColumn("__pii_names", F.flatten(F.transform(F.filter(named, lambda n: n.isNotNull()), word)))
    own = F.transform("__pii_names", lambda n: n["word"])
    hits = hits.withColumn("__pii_words", F.array_distinct(F.concat(own, F.transform(own, F.upper))))
    # names join the plain text around them again; then their words are marked, wherever they stand
    kept = lambda p, i: F.when((i % 2 == 1) & ~F.get("__pii_kinds", F.floor((i - 1) / 2).cast("int")).startswith("name"), F.concat(F.lit(MARK), p, F.lit(MARK))).otherwise(p)
    whole = F.array_join(F.transform("__pii_parts", kept), "")
    pattern = F.concat(F.lit(f"{MARK}([^{MARK}]*){MARK}|(?<!\\p{{L}})("), F.array_join("__pii_words", "|"), F.lit(")(?!\\p{L})"))
    parts = F.split(F.regexp_replace(whole, pattern, F.lit(f"{MARK}$1$2{MARK}")), MARK, -1)
    has = F.size("__pii_names") > 0
    hits = hits.withColumn("__pii_parts", F.when(has, parts).otherwise(F.col("__pii_parts")))
    return hits.withColumn("__pii_kinds", F.when(has, kinds_of(F.col("__pii_parts"), F.col("__pii_words"))).otherwise(F.col("__pii_kinds"))).drop("__pii_words")


NUMBERS = ("card", "phone", "social")


def group_of(kind: Column) -> Column:
    """All that must be distinct among themselves: kinds up to the dash."""
    return F.regexp_replace(kind, "-.*", "")


def canonical(kind: Column, entity: Column) -> Column:
    """What is equal in all spellings of an entity."""
    return (
        F.when(kind.isin(*NUMBERS), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "account", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("mail", "name"), F.lower(entity))
        .otherwise(entity)
    )


def stream(label: str, value: str, attempt: str) -> str:
    """Hex digits of a hash keyed by the column ``__pii_key``, two for each character of the value and some more."""
    block = f"sha2(concat_ws(chr(31), __pii_key, {label}, {value}, {attempt}, b), 256)"
    return f"array_join(transform(sequence(0, (length({value}) + 8) div 32), b -> {block}), '')"


def byte(hashed: str, at: str) -> str:
    return f"cast(conv(substring({hashed}, 1 + 2 * ({at}), 2), 16, 10) as int)"


def alike(value: str, hashed: str, alphabets: list[str] | None = None) -> str:
    """Each character replaced within its alphabet; others stay."""
    cases = " ".join(
        f"when instr('{a}', c) > 0 then substring('{a}', 1 + {byte(hashed, 'i')} % {len(a)}, 1)" for a in (alphabets or ALPHABETS)
    )
    return f"array_join(transform(split({value}, ''), (c, i) -> case {cases} else c end), '')"


def luhn(digits: str, last_counts_double: bool) -> str:
    """The weighted digit sum modulo 10, from the right."""
    odd = 1 if last_counts_double else 0
    d = "cast(x as int)"
    doubled = f"(2 * {d} - if(2 * {d} > 9, 9, 0))"
    return (
        f"(aggregate(transform(reverse(split({digits}, '')), (x, i) -> if((i + {odd}) % 2 = 1, {doubled}, {d})), 0, (a, x) -> a + x) % 10)"
    )


def _name(hashed: str, words: str, script: str) -> str:
    """A word of a list, or later one of syllables, more of them with each few attempts."""
    pick = lambda words, at: f"element_at(split('{words.lower()}', ' '), 1 + {byte(hashed, at)} % {len(words.split())})"
    made = f"array_join(transform(sequence(1, 2 + attempt div 3), j -> {pick(SYLLABLES[script], '8 + j')}), '')"
    return f"if(attempt < 3, {pick(words, 0)}, {made})"


def surrogate() -> Column:
    """The canonical surrogate from columns kind, canon, attempt and __pii_key."""
    h = stream("kind", "canon", "attempt")
    with_hash = lambda body: F.expr(f"transform(array({h}), h -> {body})[0]")
    domain = stream("'domain'", "split(canon, '@')[1]", "0")
    host = f"transform(array({domain}), g -> concat({alike(chr(39) + 'mailhost' + chr(39), 'g', ALPHABETS[1:2])}, '.example.', regexp_extract(canon, '[.]([a-z]+)$', 1)))[0]"
    mail = f"concat({alike('split(canon, ' + repr('@') + ')[0]', 'h', ALPHABETS[:3])}, '@', {host})"
    # the first octet is a public one unless the original's is a private network's
    octets = f"concat(if(canon like '10.%', '10', cast(11 + {byte('h', '0')} % 110 as string)), '.', {byte('h', '1')}, '.', {byte('h', '2')}, '.', 1 + {byte('h', '3')} % 254)"
    body = f"concat(1 + {byte('h', '0')} % 9, {alike('substring(canon, 2, length(canon) - 2)', 'substring(h, 3)', ALPHABETS[:1])})"
    check = f"(10 - {luhn('b', True)}) % 10"
    card = f"transform(array({body}), b -> concat(b, if({luhn('canon', False)} = 0, {check}, ({check} + 1 + {byte('h', 'length(canon)')} % 9) % 10)))[0]"
    phone = f"concat(substring(canon, 1, greatest(0, length(canon) - 10)), {alike('substring(canon, greatest(1, length(canon) - 9), 10)', 'h', ALPHABETS[:1])})"
    hexes = alike("canon", "h", ["0123456789abcdef"])
    out = F.when(F.col("kind") == "mail", with_hash(mail)).when(F.col("kind") == "address", with_hash(octets))
    out = out.when(F.col("kind") == "card", with_hash(card)).when(F.col("kind") == "phone", with_hash(phone))
    out = out.when(F.col("kind") == "key", with_hash(f"concat(substring(canon, 1, 4), {alike('substring(canon, 5)', 'h', ['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', '01', '89'])})"))
    out = out.when(F.col("kind") == "account", with_hash(f"concat(substring(canon, 1, 2), {alike('substring(canon, 3)', 'h', ALPHABETS[:3])})"))
    out = out.when((F.col("kind") == "secret") & F.col("canon").rlike("^[0-9a-f]+$"), with_hash(hexes))
    for script, letters in SCRIPTS.items():
        for role, words in [(f"name-{g}", FIRST[script, g]) for g in TITLES] + [("name-family", FAMILY[script])]:
            out = out.when((F.col("kind") == role) & F.col("canon").rlike(letters), with_hash(_name("h", words, script)))
    return out.otherwise(with_hash(alike("canon", "h")))


def render(kind: Column, entity: Column, value: Column) -> Column:
    """A canonical surrogate in the format of the spelling that it replaces."""
    spaced = F.expr(
        "array_join(aggregate(split(entity, ''), named_struct('i', 1, 'out', cast(array() as array<string>)), (a, c) -> "
        "if(c rlike '[0-9A-Za-z]', named_struct('i', a.i + 1, 'out', array_append(a.out, substring(value, a.i, 1))), "
        "named_struct('i', a.i, 'out', array_append(a.out, c))), a -> a.out), '')"
    )
    cased = F.when(entity == F.upper(entity), F.upper(value)).otherwise(F.initcap(value))
    shown = F.when(kind.isin(*NUMBERS, "account"), spaced).when(kind == "name", cased).otherwise(value)
    return F.when(value.startswith(PLACEHOLDER), value).otherwise(shown)


def assign(found: DataFrame, key: str, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """(kind, canon, value): surrogates that are distinct and no entity of the table.

    Each round settles some and tries the others again; a round writes only what it settled and
    what is left.  Where nothing can change, or a format has no free value left, a placeholder of
    type and keyed hash stands.
    """
    group = group_of(F.col("kind"))
    all_found = cut(found.select("kind", "canon").distinct(), "entities")
    originals = all_found.select(group.alias("group"), F.col("canon").alias("value")).distinct()
    scripted = F.col("kind").startswith("name") & reduce(lambda a, b: a | b, (F.col("canon").rlike(p) for p in SCRIPTS.values()))
    left = all_found.where(F.col("canon").rlike(CHANGEABLE) | scripted).select("kind", "canon", F.lit(0).alias("attempt"))
    done = None
    for attempt in range(max_attempts):
        tried = left.withColumn("__pii_key", F.lit(key)).withColumn("value", surrogate()).withColumn("group", group)
        if done is not None:
            tried = tried.join(done.select("group", "value"), ["group", "value"], "left_anti")
        free = tried.join(originals, ["group", "value"], "left_anti")
        winners = free.groupBy("group", "value").agg(F.min(F.struct("kind", "canon")).alias("w"))
        settled = cut(winners.select("group", "value", "w.kind", "w.canon"), "surrogates")
        done = settled if done is None else done.unionByName(settled)
        left = cut(left.join(settled, ["kind", "canon"], "left_anti").select("kind", "canon", F.lit(attempt + 1).alias("attempt")), "entities-left", left)
        if left.isEmpty():
            break
    rest = all_found.join(done, ["kind", "canon"], "left_anti").withColumn("group", group)
    digest = F.left(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("placeholder"), "kind", "canon"), 256), F.lit(32))
    rest = rest.select("group", F.concat(F.lit(PLACEHOLDER), "group", F.lit("-"), digest, F.lit(">")).alias("value"), "kind", "canon")
    return done.unionByName(rest)


def name_kinds(hits: DataFrame) -> DataFrame:
    """(kind, canon) of each word of a name: a first name of a gender, or a family name."""
    words = hits.select(F.explode("__pii_names").alias("n")).select(F.lower("n.word").alias("canon"), "n.first", "n.gender")
    told = lambda g: F.bool_or(F.col("first") & (F.col("gender") == g))
    each = words.groupBy("canon").agg(F.bool_or("first").alias("first"), told("m").alias("m"), told("f").alias("f"))
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("x")
    return each.select(F.when(F.col("first"), F.concat(F.lit("name-"), gender)).otherwise("name-family").alias("kind"), "canon")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with surrogates in the text, and ``n_entities``."""
    docs = docs.drop("n_entities", "__pii_marked", "__pii_row")
    columns = docs.columns
    # a generated column keeps the filters from matching the pattern again
    texts = docs.select("*", F.explode(F.array(marked(F.col("text")))).alias("__pii_marked"))
    has = F.coalesce(F.contains("__pii_marked", F.lit(MARK)), F.lit(False))
    without = texts.where(~has).select(*columns, F.lit(0).alias("n_entities"))
    hits = texts.where(has).withColumn("__pii_parts", F.split("__pii_marked", MARK, -1)).drop("text", "__pii_marked")
    hits = hits.withColumn("n_entities", ((F.size("__pii_parts") - 1) / 2).cast("int")).withColumn("__pii_row", F.monotonically_increasing_id())
    hits = cut(split_names(cut(hits, "texts-with-entities")), "texts-with-names")
    each = hits.select("__pii_row", F.posexplode("__pii_kinds").alias("at", "kind"), "__pii_parts").select("__pii_row", "at", "kind", F.get("__pii_parts", 2 * F.col("at") + 1).alias("entity"))
    each = cut(each.withColumn("canon", canonical(F.col("kind"), F.col("entity"))).withColumn("group", F.col("kind")), "places")
    values = assign(each.where("kind <> 'name'").unionByName(name_kinds(hits), allowMissingColumns=True), key)
    placed = each.join(values.select("group", "canon", "value"), ["group", "canon"]).withColumn("new", render(F.col("kind"), F.col("entity"), F.col("value")))
    rows = placed.groupBy("__pii_row").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("__pii_new"))
    text = F.array_join(F.transform("__pii_parts", lambda p, i: F.when(i % 2 == 1, F.get("__pii_new", F.floor(i / 2).cast("int"))["new"]).otherwise(p)), "")
    done = hits.join(rows, "__pii_row").withColumn("text", unshielded(text)).select(*columns, "n_entities")
    return without.unionByName(done)
