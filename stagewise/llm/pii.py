"""Surrogates for personal data: detected entities get keyed replacements of their own type and form.

A replacement keeps what its type needs to stay plausible: the brand digit and check digit of a card, the country of a
phone number or account, the host structure of an address, the script and grammatical gender of a name, letter case and
separators throughout. It depends on a key and the entity's canonical form alone, so every mention of an entity in any
spelling and any document gets the same replacement. First names and surnames are entities of their own, so that
"Mrs Anna Smith" and "Dr Smith" stay related. A first name's gender is settled once for the table: what any title or
the list of names says of it, feminine where they disagree ("Dr Emma Walker" follows "Mrs Emma Walker").

All distinct entities of the table are checked together: no two of one type (first names and surnames are one) may
share a replacement, and none may get a value that occurs as an entity itself. Those that do are drawn again until there are none; from the fifth draw on
replacements grow or take a wider range, so there always are free ones. Most are right at the first draw, which is an
expression over the text; the others are few and joined in by the text's hash. Texts without any entity take no part
in that join.

Only DataFrame functions are used. NULL text stays NULL, an empty text empty. Repeated rows get equal answers. Columns
other than the text are passed through untouched. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import stored

# What introduces a person's name, by grammatical gender, and given names that need no introduction.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Signor Господин".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Sra Doña Signora Госпожа".split(),
    "u": "Dr Prof Professor Доктор".split(),
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Daniel Peter Paul Christopher Andrew Matthew Joseph Charles Kevin Brian George Edward Steven Jonathan Alexander Benjamin Andreas Markus Matthias Wolfgang François Antoine Nicolas Philippe Alejandro Fernando Javier Pedro Luis Александр Николай Алексей Андрей Михаил Владимир Hans Jürgen Klaus Stefan Pierre Jean Jacques Carlos José Miguel Иван Сергей Дмитрий".split(),
    "f": "Anna Emma Laura Olivia Sophie Karen Nancy Lisa Margaret Jessica Rachel Hannah Katharina Petra Birgit Martina Isabelle Sylvie Valérie Chantal Isabel Ana Marta Elisa Наталья Ирина Татьяна Светлана Екатерина Людмила Mary Patricia Jennifer Linda Elizabeth Susan Sarah Emily Julia Sabine Ursula Monika Claire Camille Nathalie María Carmen Lucía Анна Ольга Елена Мария".split(),
}
# Syllables that replacement names are built of, by script.
SYLLABLES = {
    "latin": "ba be bo da do fa fe ga ha jo ka ke la le lo ma me mi na ne no pa ra re ri ro sa se so ta te to va ve vi wa".split(),
    "cyrillic": "ба бе бо ва ве га го да де до жа за ка ко ла ле ли ма ме ми на не но па ра ре ри ро са се со та те".split(),
}
ENDINGS = {("latin", "m"): ["n", "s", "rd"], ("latin", "f"): ["a", "na", "ia"], ("latin", "u"): ["l", "m", "r"],
           ("cyrillic", "m"): ["н", "р", "слав"], ("cyrillic", "f"): ["на", "ла", "ия"], ("cyrillic", "u"): ["м", "к", "л"]}

_OR = "|".join
_NAME = r"\p{Lu}[\p{L}\x{2019}'-]{1,29}"


def _titles(gender: str) -> str:
    return _OR([*TITLES[gender], *(t.upper() for t in TITLES[gender])])


_TITLE = rf"(?:{_OR(map(_titles, TITLES))})\.?"
_FIRST = rf"(?:{_OR(n for ns in GIVEN.values() for n in ns)})"
# Every kind with its pattern, grouped by what its first character is, so that most words are passed over at once.
# Kinds are tried in this order at the beginning of each word.
_BY_START = {
    r"[A-Za-z0-9._%+-]": {
        "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    },
    r"[pstakPSTAK]": {
        # A password or token: what introduces it stays. A value of signs alone is a blank of a form or a rule.
        # It is taken whole, however long it is, without the full stops after it.
        "secret": r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]key)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?(?=[_+/=.~-]*+[A-Za-z0-9])(?=[A-Za-z0-9_+/=.~!#$%^*-]{4}\.*+[A-Za-z0-9_+/=~!#$%^*-])(?:[A-Za-z0-9_+/=~!#$%^*-]++|\.++(?=[A-Za-z0-9_+/=~!#$%^*-]))++",
    },
    r"\p{Lu}": {
        "aws": r"A[KS]IA[0-9A-Z]{16}(?![A-Za-z0-9])",
        "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "name": rf"(?:{_TITLE} {_NAME}(?: {_NAME})?|{_FIRST} {_NAME})",
    },
    r"[0-9+(]": {
        "card": r"(?<![.-])[3-6]\d{3}(?:[ -]?\d){9,15}(?![\d-])",
        "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\d-])",
        "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
        "phone": r"(?:\+\d(?:[ ().-]{0,2}\d){7,14}(?!\d)|(?<![.-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-]))",
    },
    r"[0-9a-fA-F]": {
        # Eight groups, or fewer around a double colon, with a digit somewhere.
        "ip6": r"(?<!:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    },
    r"[0-9a-f]": {
        "hex": r"(?=[a-f]*[0-9])(?=[0-9]*[a-f])[a-f0-9]{32,64}(?![A-Za-z0-9])",
    },
}
PATTERNS = {kind: pattern for kinds in _BY_START.values() for kind, pattern in kinds.items()}
ANY = r"(?<![0-9A-Za-z_\x{80}-\x{10FFFF}])(?:" + _OR(f"(?={start})(?:{_OR(kinds.values())})" for start, kinds in _BY_START.items()) + ")"
_INTRODUCED = r"^((?i:[a-z_-]+)[\"']?[ ]{0,3}[=:][ ]{0,3}[\"']?)"
DIGIT_KINDS = ("card", "ssn", "phone", "iban")
NARROW_DRAWS = 4  # draws of an entity's own form; later ones are longer or of a wider range


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _kind(m: Column) -> Column:
    """Type of a match: the first whose pattern it is."""
    out = F.lit("secret")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _piece(kind: Column | str, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), text.alias("text"))


def _script(s: Column) -> Column:
    return F.when(s.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _name_pieces(m: Column) -> Column:
    """A name as pieces: title (left as it is), given name and surname, which carry gender and script as their kind."""
    title = F.regexp_extract(m, rf"^({_TITLE} )", 1)
    rest = F.regexp_replace(m, rf"^{_TITLE} ", "")
    words = F.split(rest, " ")
    by_title = reduce(lambda out, g: F.when(title.rlike(rf"^(?:{_titles(g)})\.? "), g).otherwise(out), ("m", "f"), F.lit("u"))
    gender = reduce(lambda out, g: F.when(words[0].isin(*GIVEN[g]), g).otherwise(out), ("m", "f"), by_title)
    surname = F.element_at(words, -1)
    given_piece = _piece(F.concat_ws(":", F.lit("given"), gender, _script(words[0])), words[0])
    # A feminine Slavic surname keeps its ending.
    slavic = F.when(surname.rlike(r"[\x{0430}\x{044F}]$"), "f").otherwise("u")
    last_piece = _piece(F.concat_ws(":", F.lit("surname"), slavic, _script(surname)), surname)
    plain = _piece("", title)
    return F.when(F.size(words) > 1, F.array(plain, given_piece, _piece("", F.lit(" ")), last_piece)).otherwise(F.array(plain, last_piece))


def pieces(m: Column) -> Column:
    """A match as pieces (kind, text); those of kind '' stay as they are."""
    kind = _kind(m)
    before = F.regexp_extract(m, _INTRODUCED, 1)
    value = F.array(_piece("", before), _piece(kind, F.substring(m, F.length(before) + 1, F.length(m))))
    return F.when(kind == "name", _name_pieces(m)).when(kind == "secret", value).otherwise(F.array(_piece(kind, m)))


def canonical(kind: Column, text: Column) -> Column:
    """What all mentions of one entity have in common."""
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.upper(F.regexp_replace(text, "[^A-Za-z0-9+]", "")))
        .when(kind.isin("email", "ip6") | kind.startswith("given") | kind.startswith("surname"), F.lower(text))
        .otherwise(text)
    )


def _bytes(key: str, *parts: Column) -> Column:
    """256 hex digits that depend on the key and the parts."""
    seed = F.concat_ws("\x1f", F.lit(key), *parts)
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, 2 * F.pmod(i, F.lit(128)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _characters(s: Column, each) -> Column:
    """Text made of each(character, number from 0) over the characters of s."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, each), "")


def _shaped(s: Column, digest: Column, kept: Column | int = 0, hexadecimal: bool = False) -> Column:
    """A text of the same shape: digits for digits, letters for letters; the first `kept` characters stay."""
    kept = F.lit(kept) if isinstance(kept, int) else kept

    def each(c: Column, i: Column) -> Column:
        b = _byte(digest, i)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", b)).otherwise(c)
        lead = (i == kept) & (c != "0")  # a leading digit other than zero stays one
        return (
            F.when(i < kept, c)
            .when(c.rlike("[0-9]"), F.when(lead, _pick("123456789", b)).otherwise(_pick("0123456789", b)))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b))
            .otherwise(c)
        )

    return _characters(s, each)


def _luhn(digits: Column) -> Column:
    """Sum of a number's digits by which card numbers are checked: a multiple of ten for valid ones."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    doubled = F.transform(chars, lambda c, i: F.when(i % 2 == 1, (2 * c.cast("int")) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _card(c: Column, long: Column, digest: Column) -> Column:
    def checked(drawn: Column) -> Column:
        body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
        check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
        return F.when(F.pmod(_luhn(c), F.lit(10)) == 0, F.concat(body, check)).otherwise(drawn)

    return _let(_shaped(long, digest, 1), checked)


def _iban(c: Column, digest: Column) -> Column:
    """Same country and length, and right check digits."""
    body = _shaped(F.substring(c, F.lit(5), F.length(c)), digest)
    country = F.substring(c, 1, 2)
    line = F.filter(F.split(F.concat(body, country, F.lit("00")), ""), lambda x: x != "")
    rest = F.aggregate(line, F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _grown(letters: str, digest: Column, draw: Column) -> Column:
    """What later draws append: a character more for every four draws."""
    return F.when(draw < NARROW_DRAWS, "").otherwise(F.array_join(F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(draw / NARROW_DRAWS).cast("int"))), lambda i: _pick(letters, _byte(digest, i + 64))
    ), ""))


def _ip(digest: Column, c: Column, draw: Column) -> Column:
    """An address of the same range; later draws of 192.168 are of the private range 10, then all are IPv6, private or for documentation."""
    octets = [(F.pmod(_byte(digest, F.lit(i)), F.lit(254)) + 1).cast("string") for i in range(4)]
    public = F.concat_ws(".", (F.pmod(_byte(digest, F.lit(0)), F.lit(89)) + 128 - 117).cast("string"), *octets[1:])
    inner = F.regexp_extract(c, r"^(10\.|192\.168\.|127\.)", 1)  # private and loop-back ranges stay such
    groups = [F.substring(digest, 4 * i + 1, 4) for i in range(8)]
    wide = F.when(inner == "", F.concat_ws(":", F.lit("2001:db8"), *groups[:6])).otherwise(F.concat_ws(":", F.concat(F.lit("fd"), F.substring(digest, 33, 2)), *groups[:7]))
    return (
        F.when(draw >= 2 * NARROW_DRAWS, wide)
        .when((inner == "192.168.") & (draw < NARROW_DRAWS), F.concat_ws(".", F.lit("192.168"), *octets[2:]))
        .when(inner == "192.168.", F.concat_ws(".", F.lit("10"), *octets[1:]))
        .when(inner != "", F.concat(inner, F.concat_ws(".", *octets[1:])))
        .otherwise(public)
    )


def _ip6(c: Column, digest: Column, draw: Column) -> Column:
    """An address of the same first group, which tells its range, and shape; later draws are for documentation."""
    first = F.substring_index(c, ":", 1)
    rest = F.substring(c, F.length(first) + 1, F.length(c))
    groups = [F.substring(digest, 4 * i + 1, 4) for i in range(6)]
    return F.when(draw < NARROW_DRAWS, F.concat(first, _shaped(rest, digest, hexadecimal=True))).otherwise(F.concat_ws(":", F.lit("2001:db8"), *groups))


def _email(key: str, c: Column, digest: Column, draw: Column) -> Column:
    """Local part by the whole address, host by the host alone (its top level stays), so hosts stay related.

    Short local parts have few forms of their length, so from the fifth draw on they grow.
    """
    local, host = F.substring_index(c, "@", 1), F.substring_index(c, "@", -1)
    top = F.substring_index(host, ".", -1)
    labels = F.substring(host, F.lit(1), F.length(host) - F.length(top))
    host_name = _let(_bytes(key, F.lit("host"), host), lambda by_host: _shaped(labels, by_host))
    return F.concat(_shaped(local, digest), _grown("abcdefghijklmnopqrstuvwxyz", digest, draw), F.lit("@"), host_name, top)


def _name(kind: Column, digest: Column, draw: Column) -> Column:
    """A name of the kind's script and gender, in lower case; later draws are longer."""
    out = F.lit("")
    for script, syllables in SYLLABLES.items():
        made = F.array(*[F.lit(s) for s in syllables])
        stem = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + F.floor(draw / 4).cast("int")), lambda i: F.element_at(made, F.pmod(_byte(digest, i), F.lit(len(syllables))) + 1)), "")
        for gender in "mfu":
            ends = F.array(*[F.lit(e) for e in ENDINGS[script, gender]])
            name = F.concat(stem, F.element_at(ends, F.pmod(_byte(digest, F.lit(100)), F.lit(len(ENDINGS[script, gender]))) + 1))
            out = F.when(kind.endswith(f":{gender}:{script}"), name).otherwise(out)
    return out


def draw_surrogate(key: str, kind: Column, c: Column, draw: Column) -> Column:
    """The replacement of a canonical form at a given draw, canonical itself."""
    return _let(_bytes(key, kind, c, draw.cast("string")), lambda digest: _drawn(key, kind, c, draw, digest))


def _drawn(key: str, kind: Column, c: Column, draw: Column, digest: Column) -> Column:
    named = kind.startswith("given") | kind.startswith("surname")
    digits = _grown("0", digest, draw)  # places for more digits
    long = F.concat(c, digits)
    return (
        F.when(kind == "email", _email(key, c, digest, draw))
        .when(kind == "card", _card(c, long, digest))
        .when(kind == "iban", _iban(long, digest))
        .when(kind == "ip", _ip(digest, c, draw))
        .when(kind == "ip6", _ip6(c, digest, draw))
        .when(kind == "aws", _shaped(long, digest, 4))
        .when(kind == "phone", _shaped(long, digest, F.when(c.startswith("+1"), 2).when(c.startswith("+"), 3).otherwise(0)))
        .when((kind == "hex") | ((kind == "secret") & c.rlike("^[0-9a-f]{16,}$")), _shaped(long, digest, hexadecimal=True))
        .when(named, _name(kind, digest, draw))
        .otherwise(_shaped(long, digest))
    )


def rendered(kind: Column, text: Column, surrogate: Column) -> Column:
    """A canonical replacement in the form of a mention: its separators and letter case."""
    def place(i: Column) -> Column:
        return F.length(F.regexp_replace(F.substring(text, F.lit(1), i + 1), "[^A-Za-z0-9+]", ""))

    spaced = _characters(text, lambda c, i: F.when(c.rlike("[A-Za-z0-9+]"), F.substring(surrogate, place(i), F.lit(1))).otherwise(c))
    cased = _characters(text, lambda c, i: F.when(c.rlike("[A-Z]"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1))))
    titled = F.when((text == F.upper(text)) & (F.length(text) > 1), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return (
        F.when(kind.isin(*DIGIT_KINDS), F.concat(spaced, F.substring(surrogate, place(F.length(text)) + 1, F.length(surrogate))))
        .when((kind == "email") & (F.length(surrogate) == F.length(text)), cased)
        .when(kind.startswith("given") | kind.startswith("surname"), titled)
        .otherwise(surrogate)
    )


def _matches(text: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))


def _mentions(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    """Distinct (kind, canonical) of the mentions in a table, with further columns. They are combined before anything moves."""
    held = docs.select(*columns, F.explode(F.array_distinct(_matches(text))).alias("m"))
    names = held.columns[:-1]
    held = held.select(*names, F.explode(pieces(F.col("m"))).alias("p")).filter(F.col("p.kind") != "")
    return held.select(*names, F.col("p.kind").alias("kind"), canonical(F.col("p.kind"), F.col("p.text")).alias("canonical")).distinct()


def settled(mentions: DataFrame) -> DataFrame:
    """Mentions (kind, canonical) with the kind of their entity: a first name has one gender, f before m before u."""
    of = F.regexp_replace("kind", "^given:[mfu]:", "given:").alias("of")
    return mentions.groupBy(of, "canonical").agg(F.min("kind").alias("settled"), F.collect_set("kind").alias("kinds")).select(F.explode("kinds").alias("kind"), "canonical", "settled")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct entities of a table: kind, canonical."""
    return settled(_mentions(docs, text)).select(F.col("settled").alias("kind"), "canonical").distinct()


def assignments(found: DataFrame, key: str) -> DataFrame:
    """Replacements (kind, canonical, draw, surrogate) without collisions, for distinct entities."""
    # First names and surnames look alike: a replacement serves one of either.
    space = F.when(F.col("kind").startswith("given") | F.col("kind").startswith("surname"), "name").otherwise(F.col("kind")).alias("space")
    drawn = stored(found.withColumn("draw", F.lit(0)).withColumn("surrogate", draw_surrogate(key, F.col("kind"), F.col("canonical"), F.col("draw"))), "surrogates")
    real = found.select(space, F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
    while True:
        # The first of those that share a replacement keeps it, unless it is some entity's own value.
        spaced = drawn.select("*", space)
        first = spaced.groupBy("space", "surrogate").agg(F.min(F.struct("draw", "kind", "canonical")).alias("first"))
        judged = spaced.join(first, ["space", "surrogate"]).join(real, ["space", "surrogate"], "left")
        again = F.col("real").isNotNull() | (F.col("first.canonical") != F.col("canonical")) | (F.col("first.kind") != F.col("kind"))
        if judged.filter(again).isEmpty():
            return drawn
        redrawn = judged.select("kind", "canonical", (F.col("draw") + again.cast("int")).alias("draw"), again.alias("again"), F.col("surrogate").alias("before"))
        drawn = stored(redrawn.withColumn(
            "surrogate", F.when(F.col("again"), draw_surrogate(key, F.col("kind"), F.col("canonical"), F.col("draw"))).otherwise(F.col("before"))
        ).select("kind", "canonical", "draw", "surrogate"), "surrogates")


def _entity_key(kind: Column, c: Column) -> Column:
    return F.concat_ws("\x1f", kind, c)


def replaced(docs: DataFrame, key: str, text: str = "text", counts: dict[str, str] | None = None) -> DataFrame:
    """`docs` with all entities in the text replaced; `counts` may name a column for the number of entities."""
    found = stored(settled(_mentions(docs, text)), "entities")
    assigned = assignments(found.select(F.col("settled").alias("kind"), "canonical").distinct(), key)
    # What the expression over the text alone gets wrong: later draws, and first names whose gender another mention told.
    later = found.join(assigned.withColumnRenamed("kind", "settled"), ["settled", "canonical"]).filter("draw > 0 OR kind <> settled").select("kind", "canonical", "surrogate")
    columns = docs.columns
    held = F.coalesce(F.size(_matches(text)) > 0, F.lit(False))
    rows = docs
    own = F.create_map().cast("map<string,string>")
    corrected = not later.isEmpty()
    if corrected:
        # Texts that hold such entities, by the text's hash: copies share one entry.
        known = _mentions(docs, text, F.sha2(F.col(text), 256).alias("_pii_text")).join(later, ["kind", "canonical"]).groupBy("_pii_text").agg(
            F.map_from_entries(F.collect_list(F.struct(_entity_key(F.col("kind"), F.col("canonical")), "surrogate"))).alias("_pii_later")
        )
        rows = docs.filter(held).withColumn("_pii_text", F.sha2(F.col(text), 256)).join(known, "_pii_text", "left")
        own = F.coalesce(F.col("_pii_later"), own)

    def piece(p: Column) -> Column:
        kind, mention = p["kind"], p["text"]

        def surrogate(c: Column) -> Column:
            return F.coalesce(F.element_at(own, _entity_key(kind, c)), draw_surrogate(key, kind, c, F.lit(0)))

        new = _let(canonical(kind, mention), lambda c: _let(surrogate(c), lambda s: rendered(kind, mention, s)))
        return F.when(kind == "", mention).otherwise(new)

    put = F.transform(F.col("_pii_matches"), lambda m: F.array_join(F.transform(pieces(m), piece), ""))
    between = F.split(F.col(text), ANY)
    joined = F.array_join(F.zip_with(between, put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rows = rows.withColumn("_pii_matches", _matches(text))
    new = F.when(F.size("_pii_matches") > 0, joined).otherwise(F.col(text))
    counted = [F.coalesce(F.size("_pii_matches"), F.lit(0)).cast("bigint").alias(name) for name in (counts or {}).values()]
    done = rows.select(*[new.alias(c) if c == text else F.col(c) for c in columns], *counted)
    if not corrected:
        return done
    none = [F.lit(0).cast("bigint").alias(name) for name in (counts or {}).values()]
    return done.union(docs.filter(~held).select(*columns, *none))
