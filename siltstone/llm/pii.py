"""Personal data replaced by surrogates, in DataFrame functions alone.

An entity's surrogate comes from a keyed hash of what it is and what it says: the same entity gets the same surrogate
everywhere, of the same kind, format, script and gender. Whether a name is a given one, and of which gender, is settled for each
text over all its mentions, so that one person keeps one name. Entities whose surrogates collide with another's, or with a real
entity, and only those, take the next draw of their hash until all differ. A name that a text has after a title is replaced
wherever else it stands in that text as well.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import settled

#: Draws of a hash before giving up. Names grow with each draw, so that any number of them is told apart; values of a fixed
#: format (a number of ten digits) cannot be where a corpus has nearly all there are.
DRAWS = 60

# Titles by gender; given names and syllables of surnames by script, and letters of scripts without capitals.
_TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа"), "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"), "n": ("Dr", "Prof")}
_GIVEN = {
    "f": {
        "Latin": "Anna Clara Elena Greta Irene Julia Laura Maria Nora Paula Rosa Sofia Teresa Vera Alice Diana",
        "Cyrillic": "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Татьяна Юлия Полина",
        "Greek": "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία Δήμητρα Γεωργία",
        "Armenian": "Անի Արփի Գայանե Լիլիթ Մարիամ Նարե Սոնա Տաթև",
    },
    "m": {
        "Latin": "Albert Bruno Carl David Erik Felix Georg Hugo Ivan Jonas Leo Martin Oscar Paul Simon Victor",
        "Cyrillic": "Андрей Борис Виктор Глеб Денис Иван Кирилл Максим Николай Олег Павел Роман",
        "Greek": "Γιώργος Νίκος Κώστας Δημήτρης Παύλος Πέτρος Στέφανος Μάρκος",
        "Armenian": "Արամ Արմեն Դավիթ Կարեն Նարեկ Տիգրան Հայկ Վահան",
    },
    "n": {
        "Latin": "Alex Robin Sasha Kim Noel Jules Charlie Quinn Rene Toni Jamie Marin",
        "Cyrillic": "Саша Женя Валя Шура Слава Вася Паша Тоша",
        "Greek": "Αλέξ Χάρις Φώτις Τζο Άρις Λίο",
        "Armenian": "Ալեքս Արև Լույս Հույս Նար Սիփան",
    },
}
_SYLLABLES = {
    "Latin": "ba den for gal hel kin lor mar nel ost per ras sel tam ul ver win zan bor dal fen gar",
    "Cyrillic": "ба вор гал дан зен кир лом мар нов ост пер род сел там улин фед чер шан",
    "Greek": "βα γα δη κο λα μα νι πα ρι σα τα φω",
    "Armenian": "բա գա դե կա լու մա նա սար տեր վա րա պե",
}
_LETTERS = {
    "Han": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホ",
    "Hangul": "김이박최정강조윤장임한오서신권황안송류홍민수지현우영진호",
    "Arabic": "ابتثجحخدذرزسشصضطعفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "अकखगघचछजझटठडतथदधनपफबभमयरलवशसह",
    "Thai": "กขคงจชซดตถทธนบปผพฟมยรลวสหอ",
}

_NAME_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}]*+(?:['’-](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*+)*+"
_TITLED = r"(?:" + "|".join(t for words in _TITLES.values() for t in words) + r")"
_NAMED = rf"(?<![\p{{L}}]){_TITLED}\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_CARD = r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"
_PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,7}\)?){2,5}(?![0-9])"
_KEY_ID = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
_SECRET = r"(?<=(?:token|secret|password|api_key|apikey|key) ?[=:] ?[\"'])[A-Za-z0-9+/_-]{16,}(?=[\"'])"
#: In the order in which they are tried at a place.
KINDS = (("email", _EMAIL), ("ip", _IP), ("iban", _IBAN), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE), ("key_id", _KEY_ID), ("secret", _SECRET), ("person", _NAMED))
PATTERN = "|".join(p for _, p in KINDS)
#: What a text with any entity has somewhere; it is cheap to look for.
_HINT = rf"[@0-9]|AKIA|(?<![\p{{L}}]){_TITLED}\.? [\p{{Lu}}\p{{Lt}}\p{{Lo}}]|(?:token|secret|password|api_key|apikey|key) ?[=:] ?[\"']"


def _kind(entity: Column) -> Column:
    out = F.when(entity.contains("@"), "email").when(entity.rlike(rf"^{_TITLED}\.? "), "person").when(entity.rlike("^AKIA[A-Z0-9]{16}$"), "key_id")
    out = out.when(entity.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip").when(entity.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$"), "iban").when(entity.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    out = out.when(entity.rlike("^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}$"), F.when(_luhn(entity) == 0, "card").otherwise("number"))
    return out.when(entity.rlike(r"^[+(0-9][0-9 ().-]+$"), "phone").otherwise("secret")


def _luhn(number: Column) -> Column:
    """The Luhn sum of the digits by 10."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.filter(doubled, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10


def _byte(h: Column, i: Column) -> Column:
    """Byte i, from 0, of a hash in hexadecimal, over and over."""
    return F.conv(F.substr(h, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _hash(key: str, kind: Column, value: Column, draw: Column) -> Column:
    inner, outer = (hashlib.sha256(f"{x}\0{key}".encode()).hexdigest() for x in ("inner", "outer"))  # the key itself is in no plan
    seed = F.sha2(F.concat_ws("\0", F.lit(inner), kind, value, draw.cast("string")), 256)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{outer}\0{i}\0"), seed), 256) for i in range(3)])


def _bound(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _redrawn(value: Column, h: Column, keep: int = 0) -> Column:
    """Letters and digits of the value redrawn in their class, all else and the first `keep` characters as they are."""

    def one(c: Column, i: Column) -> Column:
        out = F.when(i < keep, c)
        for group in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
            out = out.when(c.rlike(f"[{group[0]}-{group[-1]}]"), F.substr(F.lit(group), _byte(h, i) % len(group) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _hex(value: Column, h: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.substr(F.lit("0123456789abcdef"), _byte(h, i) % 16 + 1, F.lit(1))), "")


def _mod97(code: Column) -> Column:
    """A string of digits and capitals as a number, A being 10, by 97."""
    step = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(code, ""), lambda c: c != ""), F.lit(0), step)


def _iban(value: Column, h: Column) -> Column:
    """All but the country redrawn, with the check digits that belong to it."""
    drawn = _redrawn(value, h, 4)
    country, rest = F.substring(drawn, 1, 2), F.substring(drawn, F.lit(5), F.length(drawn))
    check = 98 - _mod97(F.concat(F.regexp_replace(rest, " ", ""), country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), rest)


def _tables() -> Column:
    """The words that names are made of, by kind and script, in one literal."""
    kinds = {**{f"given-{g}": by for g, by in _GIVEN.items()}, "surname": _SYLLABLES}
    words = {f"{kind}/{script}": text for kind, by in kinds.items() for script, text in by.items()}
    words |= {f"{kind}/{script}": " ".join(letters) for kind in kinds for script, letters in _LETTERS.items()}
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _named(df: DataFrame, key: str) -> DataFrame:
    """(kind, value, draw) with the hash h of each, and for names their script and the words to draw from."""
    script = F.lit("Latin")
    for name in [*_GIVEN["n"], *_LETTERS]:
        if name != "Latin":
            script = F.when(F.col("value").rlike(rf"\p{{Is{name}}}"), name).otherwise(script)
    out = df.withColumns({"h": _hash(key, F.col("kind"), F.col("value"), F.col("draw")), "script": F.when(F.col("kind").rlike("^(given-[fmn]|surname)$"), script)})
    return out.withColumn("words", F.split(F.try_element_at(_tables(), F.concat_ws("/", "kind", "script")), " "))


def _name() -> Column:
    """A name of the drawn words: more of them with each draw, so that the names are more than any vocabulary."""
    draw, letters = F.col("draw"), F.col("script").isin(*_LETTERS)
    first, more = (draw > 0).cast("int"), F.greatest(draw - 4, F.lit(0))
    surname = F.col("kind") == "surname"
    n = F.when(letters, F.greatest(F.length("value"), F.lit(2)) + first).when(surname, 3 + first + (draw > 2).cast("int")).otherwise(1 + first) + more
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", _byte(F.col("h"), i) % F.size("words")))
    return F.when(letters, F.array_join(parts, "")).when(surname, F.initcap(F.array_join(parts, ""))).otherwise(F.array_join(parts, "-"))


def _surrogate(key: str) -> Column:
    """The surrogate of an entity, or of one word of a person's name (kinds given-f, given-m, given-n, surname), by _named()."""
    kind, value, h = F.col("kind"), F.col("value"), F.col("h")
    domain = F.substring_index(value, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld))
    email = F.concat(_redrawn(F.substring_index(value, "@", 1), h), F.lit("@"), _bound(_hash(key, F.lit("domain"), domain, F.lit(0)), lambda d: _redrawn(name, d)), tld)
    ip = F.concat_ws(".", *[((_byte(h, F.lit(2 * i)) * 256 + _byte(h, F.lit(2 * i + 1))) % (223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string") for i in range(4)])
    drawn = _redrawn(value, h, 1)
    # the last digit of a card makes its Luhn sum 0
    body = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.lit("0"))
    card = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), ((10 - _luhn(body)) % 10).cast("string"))
    area = F.length(F.regexp_extract(value, r"^(\+[0-9]{1,3}(?![0-9]))?", 1))
    redrawn = _redrawn(value, h)
    phone = F.concat(F.substring(value, F.lit(1), area), F.substring(redrawn, area + 1, F.length(value)))
    out = F.when(F.col("script").isNotNull(), _name()).when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "number", value)
    out = out.when(kind == "key_id", _redrawn(value, h, 4)).when(kind == "iban", _iban(value, h))
    return out.when((kind == "secret") & value.rlike("^[0-9a-f]+$"), _hex(value, h)).otherwise(redrawn)


def _gender(person: Column) -> Column:
    title = F.regexp_extract(person, r"^([^. ]+)", 1)
    return F.when(title.isin(*_TITLES["f"]), "f").when(title.isin(*_TITLES["m"]), "m").otherwise("n")


def _mentioned(entities: Column) -> Column:
    """(kind, value) of each name word of a text's persons, settled over all its mentions: a given name or a surname as in the
    longest of them, of the gender that its titles tell (a title without gender tells none, different ones tell none)."""

    def words(person: Column) -> Column:
        names = F.slice(F.split(person, " "), 2, 10)
        size = F.size(names)
        return F.transform(names, lambda w, i: F.struct(w.alias("value"), size.alias("size"), (i < size - 1).alias("given"), _gender(person).alias("gender")))

    def settle(flat: Column) -> Column:
        def one(value: Column) -> Column:
            own = F.filter(flat, lambda x: x["value"] == value)
            told = lambda g: F.exists(own, lambda x: x["gender"] == g)
            gender = F.when(told("f") & ~told("m"), "f").when(told("m") & ~told("f"), "m").otherwise("n")
            given = F.array_max(F.transform(own, lambda x: F.struct(x["size"], x["given"].alias("given"))))["given"]
            return F.struct(F.when(given, F.concat(F.lit("given-"), gender)).otherwise("surname").alias("kind"), value.alias("value"))

        return F.transform(F.array_distinct(flat["value"]), one)

    persons = F.filter(F.array_distinct(entities), lambda e: _kind(e) == "person")
    return _bound(F.array_distinct(F.flatten(F.transform(persons, words))), settle)


def assigned(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value) rows: surrogates of a class differ from each other and from all values.

    Names are told apart within their class (given names of a gender, surnames), the others among themselves. A draw that is
    taken is drawn again, the others stay. An empty table gives no rows; values are not null.
    """
    real = values.select("kind", F.col("value").alias("surrogate")).withColumn("used", F.lit(True))
    pending, done = values.withColumn("draw", F.lit(0)), []
    for _ in range(DRAWS):
        drawn = settled(_named(pending, key).select("kind", "value", "draw", _surrogate(key).alias("surrogate")))
        # the least value of those with one surrogate keeps it, unless it is used already: counted before they move
        first = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count("*").alias("n"))
        used = real
        for part in done:
            used = used.unionByName(part.select("kind", "surrogate", F.lit(True).alias("used")))
        taken = settled(first.join(used, ["kind", "surrogate"], "left").where("(n > 1 or used) and kind != 'number'").select("kind", "surrogate", F.when(F.col("used").isNull(), F.col("first")).alias("first"), F.lit(True).alias("again")))
        if not taken.take(1):
            done.append(drawn.select("kind", "value", "surrogate"))
            break
        moved = drawn.join(taken, ["kind", "surrogate"], "left")
        again = F.col("again").isNotNull() & ~F.coalesce(F.col("first") == F.col("value"), F.lit(False))
        moved = settled(moved.select("kind", "value", "surrogate", "draw", again.alias("again")))
        done.append(moved.where(~F.col("again")).select("kind", "value", "surrogate"))
        pending = moved.where("again").select("kind", "value", (F.col("draw") + 1).alias("draw"))
    else:
        if pending.take(1):
            raise RuntimeError(f"a format has too few values for distinct surrogates ({DRAWS} draws)")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def replaced(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the personal data in each whole text replaced; with count_col, how many places were replaced in each text.

    Null texts stay null and have none; empty texts stay; repeated rows get the same text; all other columns stay, and
    those of docs may have any names; one named count_col is replaced. Texts of any length are taken whole. Texts without
    entities are not moved; the others are moved once, with their entities, and no row holds more than its own text's
    entities. An empty table gives no rows.
    """
    docs = docs.drop(count_col) if count_col else docs
    text = F.col(f"`{text_col}`")
    found = F.coalesce(text.rlike(_HINT) & text.rlike(PATTERN), F.lit(False))
    counted = [count_col] if count_col else []
    plain = docs.where(~found)
    if count_col:
        plain = plain.withColumn(count_col, F.lit(0))
    rows = docs.where(found).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    inner = F.col("row").getField(text_col)
    rows = rows.withColumn("entities", F.regexp_extract_all(inner, F.lit(f"({PATTERN})"), F.lit(1)))
    rows = rows.withColumn("names", _mentioned(F.col("entities"))).withColumn("long", F.filter("names", lambda w: F.length(w["value"]) > 1))
    # names of the text again, without a title: letters, apostrophes and hyphens only, so they need no escapes
    again = F.concat(F.lit(rf"{PATTERN}|(?<![\p{{L}}\p{{M}}\p{{N}}])(?:"), F.array_join(F.col("long")["value"], "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    named = F.size("long") > 0
    every = F.when(named, F.regexp_extract_all(inner, F.concat(F.lit("("), again, F.lit(")")), F.lit(1))).otherwise(F.col("entities"))
    pieces = F.when(named, F.split(inner, again, -1)).otherwise(F.split(inner, PATTERN, -1))
    rows = settled(rows.withColumns({"pieces": pieces, "entities": every}).withColumn("at", F.monotonically_increasing_id()))

    def words_of(entity: Column) -> Column:
        """What of an entity gets surrogates: a person's words, and names without title, as the text's mentions settle them."""
        own = F.when(_kind(entity) == "person", F.slice(F.split(entity, " "), 2, 10)).otherwise(F.array(entity))
        other = lambda w: F.struct(_kind(entity).alias("kind"), w.alias("value"))
        return F.transform(own, lambda w: F.coalesce(F.get(F.filter("names", lambda x: x["value"] == w), F.lit(0)), other(w)))

    each = rows.select("at", "names", F.explode(F.array_distinct("entities")).alias("entity"))
    words = each.select("at", F.explode(words_of(F.col("entity"))).alias("w")).select("at", "w.kind", "w.value").distinct()
    surrogates = assigned(settled(words.select("kind", "value").distinct()), key)
    pair = F.struct(F.concat_ws("\0", "kind", "value").alias("key"), F.col("surrogate").alias("value"))
    maps = words.join(surrogates, ["kind", "value"]).groupBy("at").agg(F.map_from_entries(F.collect_set(pair)).alias("known"))

    def new(entity: Column) -> Column:
        parts = F.transform(words_of(entity), lambda w: F.try_element_at("known", F.concat_ws("\0", w["kind"], w["value"])))
        joined = F.array_join(parts, " ")
        return F.when(_kind(entity) == "person", F.concat(F.regexp_extract(entity, r"^(\S+ )", 1), joined)).otherwise(joined)

    fresh = F.transform("entities", new)
    whole = F.array_join(F.flatten(F.zip_with("pieces", fresh, lambda p, e: F.array(F.coalesce(p, F.lit("")), F.coalesce(e, F.lit(""))))), "")
    changed = rows.join(maps, "at", "left").withColumn("_new", whole)
    columns = [(F.col("_new") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    number = F.size(F.filter("entities", lambda e: _kind(e) != "number"))
    return plain.unionByName(changed.select(*columns, *[number.alias(c) for c in counted]))
