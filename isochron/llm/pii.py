"""Personal data: surrogate generation, in DataFrame operations only.

One expression finds the entities (e-mail addresses, phone numbers, IPv4, IPv6 and MAC addresses, payment cards, IBANs,
social security numbers, secrets and titled names of up to three words and particles); a text is split around them and each gets a surrogate derived from
sha2(key, type, canonical form, attempt): the same entity gets the same surrogate everywhere (coreference), whatever its
spelling's case or separators, and the surrogate keeps the type's format: separators, country code, digits, letter case,
hexadecimal alphabet, the check digits of cards and IBANs, IPv4 form, and for names the script and the person's gender.

Names are two entities: the family name, so that 'Mr Doe' and 'Ms Jane Doe' stay one family, and the given name within
its family. A person's gender is what all their titles in the table say; where they say both or none, it is neutral. In
a text that names somebody with a title, mentions of the full or the family name alone are replaced as well, in capitals
too; a name that is a plain word (PLAIN) is replaced only with its title. A title before an office or the like (NOT_NAMES)
is none.

Collision checks: all distinct entities of the table are assigned attempt 0; while two entities of one type share a
surrogate, or a surrogate is itself an entity of the table, all but the first of them take the next attempt. The
canonical form of a surrogate depends on the entity's canonical form alone, so one spelling of each stands for all. Only
entities are shuffled for this, never texts. The few that ended with a later attempt, or whose titles differ, are joined
back to the rows that hold them; with none, the rewriting is one map-only pass over the texts.

The key is the caller's: with it, surrogates can be made again; without it, they can't be looked up.

Defined results: null text stays null with no entities; text without an entity is kept byte for byte; repeated rows each
get a row; null doc_ids are kept; columns other than the text pass through. A name without a title anywhere in its text
is not found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isochron.llm.common import cut

#: Titles with the gender they show, in several languages and scripts.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Anna", "Clara", "Diana", "Elena", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Teresa", "Vera"),
    ("latin", "m"): ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("latin", "n"): ("Alex", "Andrea", "Chris", "Dana", "Eden", "Jamie", "Jordan", "Kim", "Lee", "Luca", "Noa", "Robin", "Sam", "Sascha", "Toni", "Val"),
    ("cyrillic", "f"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава", "Шура", "Ника", "Мика", "Паша"),
    ("greek", "f"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Πέτρος", "Φίλιππος"),
    ("greek", "n"): ("Άρης", "Φοίβη", "Ίρις", "Δάφνη"),
}
#: Syllables that family names are put together from.
SYLLABLES = {
    "latin": ("ba", "be", "bor", "da", "den", "dor", "fal", "fen", "ga", "gor", "hal", "hen", "ka", "kel", "kor", "la", "len", "lor", "ma", "men", "mor", "na", "nel", "nor", "ra", "ren", "ros", "sal", "sen", "ta", "ten", "tor"),
    "cyrillic": ("ба", "вел", "гор", "да", "зан", "ка", "лен", "мор", "на", "пол", "ра", "сер", "та", "фе", "ха", "шан"),
    "greek": ("βα", "γε", "δη", "θα", "κα", "λε", "μα", "νι", "πα", "ρο", "σα", "τε", "φι", "χα", "ψη", "ζα"),
}
#: What a title may stand before that is no name, and words that are left alone where they stand without one.
NOT_NAMES = ("President", "Chairman", "Chairwoman", "Speaker", "Minister", "Chancellor", "Ambassador", "Secretary", "Justice", "Mayor", "Universe", "World", "America", "Who", "Right", "Wrong", "Perfect")
PLAIN = ("will", "may", "can", "might", "must", "who", "what", "when", "where", "why", "how", "which", "the", "this", "that", "and", "but", "for", "not", "you", "she", "they", "have", "has", "was", "are", "is", "it", "in", "on", "so", "long", "short", "small", "young", "old", "new", "good", "best", "white", "black", "brown", "green", "gray", "rose", "hope", "grace", "faith", "joy", "dawn", "summer", "april", "june", "august", "mark", "bill", "art", "rich", "frank", "king", "queen", "prince", "day", "may", "street", "house", "church", "president", "minister")
#: Lower-case words inside a name.
_particle = "(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|bin|al|ter|zu|zum)"
_word = r"\p{Lu}[\p{L}'\-]+"
_titles = "|".join(t for group in TITLES.values() for t in sorted(group, key=len, reverse=True))
_initials = "".join(sorted({t[0] for group in TITLES.values() for t in group}))
#: Java regular expressions by type, in order of precedence. None repeats a group without bound: that would recurse.
ENTITIES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@(?=[A-Za-z0-9\-]{1,200}\.[A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9.\-]*[A-Za-z0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{1,4}(?:[ \-]?[0-9]{1,3})?(?![0-9A-Za-z])",
    "mac": r"(?<![0-9A-Za-z:\-])(?:[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}|[0-9A-Fa-f]{2}(?:-[0-9A-Fa-f]{2}){5})(?![0-9A-Za-z:\-])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|(?=[0-9A-Fa-f:]{4,39}(?![0-9A-Za-z:]))[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9])(?!\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,5}\)[ .\-]?)?[0-9]{2,5}(?:[ .\-/][0-9]{2,5}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{7,15}(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:sk|pk|ghp|gho|xox[abp])[_\-][A-Za-z0-9_\-]{16,100}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "name": rf"(?=[{_initials}])(?<![\p{{L}}])(?:{_titles})\.? {_word}(?:(?: {_particle}){{0,2}} {_word}){{0,2}}",
}
#: A phone number has at least this many digits, and is neither a date nor a number in groups of three.
PHONE_DIGITS = 8
NO_PHONE = r"^(?:[0-9]{1,4}([./\-])[0-9]{1,2}\1[0-9]{1,4}|[0-9]{1,3}(?:[ .][0-9]{3})+)$"
_foreign = "".join(c for c in _initials if c > "\x7f")
#: No entity begins inside a word of ASCII letters and digits, so the alternatives are tried at few places.
PATTERN = rf"(?<![0-9A-Za-z])(?=[0-9A-Za-z._%+(\-{_foreign}])(?:{'|'.join(ENTITIES.values())})"
#: Calling codes (fixed values): one digit, or two; all others have three.
CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
MAX_ATTEMPTS = 64
MAX_BROADCAST = 100_000


def kind_of(entity: Column) -> Column:
    """The entity's type, null for a match that is none after all."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(ENTITIES.items()):
        whole = entity.rlike(rf"^(?:{pattern})$")
        if name == "phone":
            whole &= (F.length(F.regexp_replace(entity, "[^0-9]", "")) >= PHONE_DIGITS) & ~entity.rlike(NO_PHONE)
        if name == "name":
            whole &= ~untitled(entity).isin(*NOT_NAMES)
        out = F.when(whole, F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What spellings of one entity share: case of e-mail addresses, separators of numbers, spaces, a name's title."""
    return (
        F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "iban", "ssn"), F.regexp_replace(entity, r"[ \-]", ""))
        .when(kind == "phone", F.regexp_replace(entity, r"[^0-9+]", ""))
        .when(kind == "mac", F.lower(F.regexp_replace(entity, r"[:\-]", "")))
        .when(kind == "ipv6", F.regexp_replace(F.lower(entity), r"(?<![0-9a-f])0+(?=[0-9a-f])", ""))
        .when(kind == "name", F.lower(F.regexp_replace(entity, rf"^(?:{_titles})\.? ", "")))
        .otherwise(entity)
    )


def _digits(h: Column) -> Column:
    return F.translate(h, "abcdef", "274958")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pick(h: Column, at: int | Column, options: Column) -> Column:
    """One of the options by two hexadecimal digits of h."""
    return F.element_at(options, F.pmod(F.conv(F.substring(h, at, F.lit(2) if isinstance(at, Column) else 2), 16, 10).cast("int"), F.size(options)) + 1)


def _mapped(entity: Column, stream: Column, first: int = 0) -> Column:
    """Digits by digits and letters by letters of the same case, from the stream; the first characters and the rest stay."""
    letters = F.translate(stream, "0123456789abcdef", "kqtxzbmprsjvwgdc")
    at = lambda i: F.pmod(i, F.lit(64)) + 1
    one = lambda c, i: (
        F.when((i < first) | ~c.rlike("[0-9A-Za-z]"), c)
        .when(c.rlike("[0-9]"), F.substring(_digits(stream), at(i), F.lit(1)))
        .when(c.rlike("[a-z]"), F.substring(letters, at(i), F.lit(1)))
        .otherwise(F.upper(F.substring(letters, at(i), F.lit(1))))
    )
    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn(entity: Column) -> Column:
    """The entity with its last digit set so that its digits pass the Luhn check."""
    numbers = F.split(F.reverse(F.regexp_replace(entity, "[^0-9]", "")), "")
    value = lambda c, i: F.when(i == 0, F.lit(0)).when(i % 2 == 1, (2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))
    total = F.aggregate(F.transform(numbers, value), F.lit(0), lambda a, b: a + b.cast("int"))
    return F.concat(F.substring(entity, F.lit(1), F.length(entity) - 1), F.pmod(-total, F.lit(10)).cast("string"))


def _email(h: Column, stem: Column) -> Column:
    letters = F.translate(h, "0123456789abcdef", "kqtxzbmprsjvwgdc")
    number = F.regexp_extract(stem, "([0-9]*)@", 1)
    mark = F.regexp_extract(stem, r"([._\-]?)[0-9]*@", 1)
    return F.concat(F.substring(letters, 1, 12), mark, F.substring(_digits(h), F.lit(13), F.length(number)), F.lit("@"), F.substring(letters, 40, 8), F.lit(".example"))


def _ip(h: Column) -> Column:
    """An address of 240.0.0.0/4, which is reserved: it belongs to no one."""
    part = lambda at: F.conv(F.substring(h, at, 2), 16, 10)
    return F.concat_ws(".", (240 + F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 15).cast("string"), part(2), part(4), part(6))


def _hexed(h: Column, entity: Column, first: str) -> Column:
    """New hexadecimal digits in the places and the case of the old ones, but for the first two, which are given."""
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Fa-f]", ""))
    # As many digits in all as the hash has, at most; a group's first one is no zero, so that spellings stay as long.
    one = lambda c, i: F.when(~c.rlike("[0-9A-Fa-f]"), c).otherwise(_let(place(i), lambda p: F.when(p <= 2, F.substring(F.lit(first), p, F.lit(1))).otherwise(F.translate(F.substring(h, p, F.lit(1)), "0", "1"))))
    made = F.array_join(F.transform(F.split(entity, ""), one), "")
    return F.when(entity.rlike("[A-F]"), F.upper(made)).otherwise(made)


def _number(h: Column, entity: Column, stem: Column) -> Column:
    """New digits in the places of the old ones but for a calling code; numbers that differ in separators agree."""
    code = F.greatest(F.length(F.regexp_extract(stem, CODES, 0)) - 1, F.lit(0))
    place = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", ""))
    digit = lambda d, c, p: F.when(p <= code, c).otherwise(F.substring(d, F.pmod(p - 1, F.lit(64)) + 1, F.lit(1)))
    return _let(_digits(h), lambda d: F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(~c.rlike("[0-9]"), c).otherwise(digit(d, c, place(i)))), ""))


def untitled(entity: Column) -> Column:
    return F.regexp_replace(entity, rf"^(?:{_titles})\.? ", "")


def titled_gender(entity: Column) -> Column:
    """The gender that a name's title shows: f, m, or n for neither."""
    title = F.regexp_extract(entity, rf"^({_titles})\.? ", 1)
    return F.when(title.isin(*TITLES["f"]), "f").when(title.isin(*TITLES["m"]), "m").otherwise("n")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _styled(new: Column, old: Column) -> Column:
    return F.when(old == F.upper(old), F.upper(new)).otherwise(new)


def _given(h: Column, name: Column, gender: Column, attempt: Column) -> Column:
    """A given name of the script and gender for each one; later attempts join two or three, so that no family runs out."""
    options = F.create_map(*(x for (which, sex), names in GIVEN.items() for x in (F.lit(f"{which} {sex}"), F.array(*map(F.lit, names)))))
    chosen = lambda names: F.concat_ws("-", _pick(h, 1, names), F.when(attempt >= 4, _pick(h, 21, names)), F.when(attempt >= 12, _pick(h, 31, names)))
    words = F.split(name, " ")
    more = lambda names: F.transform(F.slice(words, 2, 8), lambda w, i: F.when(w.rlike(r"^\p{Lu}"), _pick(h, F.lit(41) + 2 * i, names)).otherwise(w))
    return _styled(_let(F.element_at(options, F.concat_ws(" ", _script(name), gender)), lambda names: F.concat_ws(" ", F.array(chosen(names)), more(names))), name)


def _family(h: Column, name: Column) -> Column:
    parts = F.create_map(*(x for which, names in SYLLABLES.items() for x in (F.lit(which), F.array(*map(F.lit, names)))))
    return _styled(_let(F.element_at(parts, _script(name)), lambda p: F.initcap(F.concat(*(_pick(h, at, p) for at in range(3, 15, 2))))), name)


def _secret(h: Column, entity: Column, key: str) -> Column:
    hexed = F.substring(F.concat(h, F.sha2(F.concat(h, F.lit(key)), 256)), F.lit(1), F.length(entity))
    return F.when(entity.rlike("^[0-9a-f]+$"), hexed).when(entity.rlike("^[0-9A-F]+$"), F.upper(hexed)).otherwise(_mapped(entity, h, 4))


def _iban(h: Column, entity: Column, stem: Column) -> Column:
    """Country and layout stay; the check digits are those of the new account (mod 97)."""
    account = F.substring(_mapped(stem, h, 4), 5, 64)
    numbered = F.concat(account, F.substring(stem, 1, 2), F.lit("00"))
    rest = F.aggregate(F.split(numbered, ""), F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.ascii(c) - 55), F.lit(97)))
    plain = F.concat(F.substring(stem, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), account)
    return F.when(entity.contains(" "), F.trim(F.regexp_replace(plain, "(.{4})", "$1 "))).otherwise(plain)


def surrogate(kind: Column, entity: Column, stem: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Keyed replacement of an entity; equal canonical forms of one type give replacements that differ in form only.

    A given name's stem is the whole name in lower case, its entity the given name as it is written.
    """
    made = lambda h: (
        F.when(kind == "email", _email(h, stem))
        .when(kind == "ip", _ip(h))
        .when(kind == "mac", _hexed(h, entity, "02"))
        .when(kind == "ipv6", _hexed(h, entity, "fd"))
        .when(kind == "card", _luhn(_number(h, entity, stem)))
        .when(kind.isin("phone", "ssn"), _number(h, entity, stem))
        .when(kind == "family", _family(h, entity))
        .when(kind == "given", _given(h, entity, gender, attempt))
        .when(kind == "secret", _secret(h, entity, key))
        .when(kind == "iban", _iban(h, entity, stem))
        .otherwise(entity)
    )
    return _let(F.sha2(F.concat_ws("\x1f", F.lit(key), kind, stem, attempt.cast("string")), 256), made)


def entities(text: str = "text") -> Column:
    """array<struct<kind, entity, stem>> of a text's matches, in order; kind is null for a match that is left as it is."""
    found = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    return F.transform(found, lambda e: _let(kind_of(e), lambda k: F.struct(k.alias("kind"), e.alias("entity"), canonical(k, e).alias("stem"))))


def components(e: Column) -> Column:
    """array<struct<kind, stem, entity>>: an entity by itself, a name as its family name and, where it has one, all before it."""
    rest = untitled(e["entity"])
    family = F.struct(F.lit("family").alias("kind"), F.element_at(F.split(e["stem"], " "), -1).alias("stem"), F.element_at(F.split(rest, " "), -1).alias("entity"))
    given = F.struct(F.lit("given").alias("kind"), e["stem"].alias("stem"), F.regexp_replace(rest, r" [^ ]+$", "").alias("entity"))
    alone = F.array(F.struct(e["kind"].alias("kind"), e["stem"].alias("stem"), e["entity"].alias("entity")))
    return F.when(e["kind"] != "name", alone).when(rest.contains(" "), F.array(family, given)).otherwise(F.array(family))


def _assigned(known: DataFrame, key: str) -> DataFrame:
    """(kind, stem) with a later attempt or with titles of more than one gender, with attempt and gender.

    known: (kind, stem, entity, gender, mixed), a row for each kind and stem.
    """
    state = known.withColumn("attempt", F.lit(0))
    for _ in range(MAX_ATTEMPTS):
        new = surrogate(F.col("kind"), F.col("entity"), F.col("stem"), F.col("gender"), F.col("attempt"), key)
        # Given names need to differ within their family only.
        made = F.when(F.col("kind") == "given", F.concat(F.lower(new), F.lit("|"), F.element_at(F.split("stem", " "), -1)))
        made = made.when(F.col("kind") == "family", F.lower(new)).otherwise(canonical(F.col("kind"), new))
        made = cut(state.withColumn("made", made))
        firsts = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "stem")).alias("first"), F.count("*").alias("n"))
        shared = made.join(firsts.filter("n > 1"), ["kind", "made"]).filter((F.col("stem") != F.col("first.stem"))).select("kind", "stem")
        real = made.join(known.select("kind", F.col("stem").alias("made")), ["kind", "made"], "left_semi").select("kind", "stem")
        again = cut(shared.union(real).distinct())
        if again.isEmpty():
            return state.filter("attempt > 0 or mixed").select("kind", "stem", "attempt", "gender")
        bumped = state.join(again.withColumn("bump", F.lit(1)), ["kind", "stem"], "left")
        state = cut(bumped.select("kind", "stem", "entity", "gender", "mixed", (F.col("attempt") + F.coalesce("bump", F.lit(0))).alias("attempt")))
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def known_entities(docs: DataFrame, text: str) -> DataFrame:
    """(kind, stem, entity, gender, mixed) of each distinct entity; gender and mixed are of a person's titles."""
    found = docs.select(F.explode(entities(text)).alias("e")).filter("e.kind is not null")
    parts = found.select(F.explode(components(F.col("e"))).alias("c"), titled_gender(F.col("e.entity")).alias("title"))
    says = lambda g: F.max((F.col("title") == g).cast("int")) > 0
    grouped = parts.groupBy("c.kind", "c.stem").agg(F.min("c.entity").alias("entity"), says("f").alias("f"), says("m").alias("m"), (F.min("title") != F.max("title")).alias("differ"))
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    return cut(grouped.select("kind", "stem", "entity", gender.alias("gender"), (F.col("differ") & (F.col("kind") == "given")).alias("mixed")))


def replace(docs: DataFrame, key: str, text: str = "text", chars: str | None = None, counts: bool = True) -> DataFrame:
    """The documents with surrogates in their text, and n_entities and entity_kinds after their columns if wanted.

    A column named by `chars` is counted anew where the text changes.
    """
    later = _assigned(known_entities(docs, text), key)

    # Numbered names: whatever the columns are called, none clashes with those that are added here.
    columns = docs.columns
    docs = docs.toDF(*(f"c{k}" for k in range(len(columns))))
    at, n_chars = f"c{columns.index(text)}", f"c{columns.index(chars)}" if chars in columns else None
    marked = docs.withColumn("pii_found", F.coalesce(entities(at), F.array()))
    if later.isEmpty():
        marked = marked.withColumn("pii_later", F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    else:
        row = F.xxhash64(at)
        held = docs.select(row.alias("pii_row"), F.explode(entities(at)).alias("e")).filter("e.kind is not null").select("pii_row", F.explode(components(F.col("e"))).alias("c"))
        hits = held.select("pii_row", "c.kind", "c.stem").join(later, ["kind", "stem"]).distinct()
        hits = cut(hits.groupBy("pii_row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "stem"), F.struct("attempt", "gender")))).alias("pii_later")))
        hits = F.broadcast(hits) if hits.count() <= MAX_BROADCAST else hits
        marked = marked.withColumn("pii_row", row).join(hits, "pii_row", "left").drop("pii_row")

    def part(c: Column, gender: Column) -> Column:
        decided = F.try_element_at("pii_later", F.concat_ws("\x1f", c["kind"], c["stem"]))
        return surrogate(c["kind"], c["entity"], c["stem"], F.coalesce(decided["gender"], gender), F.coalesce(decided["attempt"], F.lit(0)), key)

    def made(e: Column) -> Column:
        """The surrogates of an entity's components: of a name, the family name's and the given name's."""
        return F.transform(components(e), lambda c: part(c, titled_gender(e["entity"])))

    def named(new: Column) -> Column:
        return F.concat_ws(" ", F.try_element_at(new, F.lit(2)), F.element_at(new, 1))

    title = lambda e: F.when(e["kind"] == "name", F.regexp_extract(e["entity"], rf"^(?:{_titles})\.? ", 0)).otherwise("")
    replaced = F.transform("pii_found", lambda e: F.when(e["kind"].isNull(), e["entity"]).otherwise(F.concat(title(e), named(made(e)))))
    real = F.filter("pii_found", lambda e: e["kind"].isNotNull())
    marked = marked.withColumn("pii_new", F.when(F.size(real) > 0, replaced))

    # What a text's titled names are called elsewhere in it: the full and the family name, as written, in capitals, and as
    # usual where they are written in capitals. What is made of a form depends on form and stem alone.
    aliases = lambda f, new: F.array(F.struct(f.alias("called"), named(new).alias("new")), F.struct(F.element_at(F.split(f, " "), -1).alias("called"), F.element_at(new, 1).alias("new")))
    forms = lambda e: _let(untitled(e["entity"]), lambda f: F.array_distinct(F.array(f, F.upper(f), F.when(f == F.upper(f), F.initcap(f)).otherwise(f))))
    of_form = lambda e, f: F.transform(components(F.struct(e["kind"].alias("kind"), f.alias("entity"), e["stem"].alias("stem"))), lambda c: part(c, titled_gender(e["entity"])))
    called = lambda e: F.flatten(F.transform(forms(e), lambda f: _let(of_form(e, f), lambda new: aliases(f, new))))
    people = F.filter("pii_found", lambda e: e["kind"] == "name")
    elsewhere = F.filter(F.array_distinct(F.flatten(F.transform(people, called))), lambda a: ~F.lower(a["called"]).isin(*PLAIN))
    marked = marked.withColumn("pii_names", F.when(F.size(people) > 0, F.map_from_entries(elsewhere)))
    marked = marked.withColumn("pii_names", F.when(F.size("pii_names") > 0, F.col("pii_names")))
    longest = F.array_sort(F.map_keys("pii_names"), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    marked = marked.withColumn("pii_pattern", F.when(F.col("pii_names").isNotNull(), F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(longest, "|"), F.lit(r")(?!\p{L})"))))

    parts = F.split(F.col(at), PATTERN, -1)
    woven = lambda between, new: F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    mentions = lambda p: woven(F.split(p, F.col("pii_pattern"), -1), F.transform(F.regexp_extract_all(p, F.col("pii_pattern"), F.lit(0)), lambda m: F.element_at(F.col("pii_names"), m)))
    parts = F.when(F.col("pii_pattern").isNull(), parts).otherwise(F.transform(parts, mentions))
    out = marked.withColumn("pii_text", F.when(F.col("pii_new").isNotNull(), woven(parts, F.col("pii_new"))).otherwise(F.col(at)))
    value = lambda k, c: F.col("pii_text") if c == at else F.when(F.size("pii_found") > 0, F.length("pii_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)) if c == n_chars else F.col(c)
    kinds = F.array_join(F.sort_array(F.array_distinct(F.transform(real, lambda e: e["kind"]))), ",")
    added = [F.size(real).cast("long").alias("n_entities"), kinds.alias("entity_kinds")] if counts else []
    return out.select(*(value(k, f"c{k}").alias(c) for k, c in enumerate(columns)), *added)
