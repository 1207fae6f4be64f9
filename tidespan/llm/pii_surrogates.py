"""PII surrogates: detected entities get keyed replacements of the same type, gender, script and format.

The same entity gets the same surrogate everywhere (coreference), in whatever case or punctuation it is written, and
different entities get different ones: candidates are compared over the whole corpus, and an entity whose candidate is
taken, or is itself an entity of the corpus, gets the next one of its keyed sequence. Only distinct entities are
shuffled, pre-aggregated; texts never are, unless more entities than inline_limit needed a later candidate, and then
only documents that hold entities. Built-in functions only.

Types: email, secret, iban, card (Luhn-valid stays valid), ssn, ip, phone, and names after a title (gender by the title,
script by the letters). A phone's leading country code (unless the numbers left under it run out), an email's top-level
domain and an IBAN's country stay.

Defined results: null text stays null with 0 entities; empty text stays empty; repeated rows are rewritten alike; other
columns pass through, and n_entities and entity_types replace columns so named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidespan.session import store

#: Titles by gender, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Diana", "Elena", "Flora", "Greta", "Hanna", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sara", "Vera"],
    ("m", "latin"): ["Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Oscar", "Paul", "Simon"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Олег", "Павел"],
    ("f", "greek"): ["Άννα", "Δάφνη", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Νίκη", "Σοφία"],
    ("m", "greek"): ["Άρης", "Γιώργος", "Δήμος", "Ηλίας", "Κώστας", "Μάνος", "Νίκος", "Πέτρος"],
}
SYLLABLES = {
    "latin": ["ba", "den", "fol", "gar", "hin", "kel", "lom", "mar", "nes", "pol", "ren", "sal", "tor", "var", "wen", "zim"],
    "cyrillic": ["ба", "ден", "фол", "гар", "кел", "лом", "мар", "нес", "пол", "рен", "сал", "тор", "вар", "вен", "зим", "хол"],
    "greek": ["βα", "δεν", "φολ", "γαρ", "κελ", "λομ", "μαρ", "νεσ", "πολ", "ρεν", "σαλ", "τορ", "ζιμ", "θαν", "χολ", "ξεν"],
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": "(?<![\\p{L}\\p{N}._%+-])[\\p{L}\\p{N}._%+-]{1,64}+@(?:[\\p{L}\\p{N}-]{1,63}\\.){1,8}[A-Za-z]{2,24}",
    "secret": "(?<![\\p{L}\\p{N}])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\\s{0,3}[=:]\\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}+|(?<![\\p{L}\\p{N}])[0-9a-fA-F]{32,}+(?![\\p{L}\\p{N}])",
    "name": "(?<![\\p{L}\\p{N}])(?:" + "|".join(t for g in TITLES.values() for t in g) + ")\\.? \\p{Lu}[\\p{L}'-]{1,40}(?: \\p{Lu}[\\p{L}'-]{1,40})?",
    "iban": "(?<![\\p{L}\\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "phone": "(?<![\\p{L}\\p{N}+])\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\\p{L}\\p{N}])(?:\\([0-9]{3}\\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "(?<![\\p{L}0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![\\p{L}0-9])",
    "ip": f"(?<![\\p{{L}}0-9.]){OCTET}(?:\\.{OCTET}){{3}}(?![0-9]|\\.[0-9])",
}
ANY = "|".join(PATTERNS.values())
#: A phone's country code, by the numbering zones; it changes too where so many candidates with it were taken.
CODE = "^\\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
CODE_ATTEMPTS = 50
#: Attempts after which surnames get another syllable, again and again.
LONGER = 4
#: What every match holds; a long run of hexadecimal letters may hold no digit.
HINT = "[0-9@]|[a-fA-F]{32}|" + PATTERNS["name"] + "|(?i:token|secret|pass|key)"


def chained(items: Column, *steps) -> Column:
    """Applies the steps to each struct of an array, one after another. Each step adds named fields, so that nothing is computed twice."""
    def wider(names: list[str], step):
        return lambda e: F.struct(*[e[n].alias(n) for n in names], *[c.alias(n) for n, c in step(e).items()])

    for names, step in steps:
        items = F.transform(items, wider(names, step))
    return items


def entities_of(hits: Column) -> Column:
    """Structs of the matches: type (names with gender and script), key (what coreferring matches share), head (kept as it is) and body."""

    def kind(e: Column) -> dict:
        out = F.lit("ip")
        for k in ("card", "ssn", "phone", "iban", "name", "secret", "email"):
            whole = "^(?:" + PATTERNS[k].replace("(?<![\\p{L}0-9.-])", "").replace("(?<![0-9-])", "") + ")$"
            out = F.when(e["found"].rlike(whole), F.lit(k)).otherwise(out)
        return {"kind": out}

    def head(e: Column) -> dict:
        found, kind = e["found"], e["kind"]
        out = (
            F.when(kind == "name", F.regexp_extract(found, "^\\S+ ", 0))
            .when(kind == "secret", F.regexp_extract(found, "^(?:.*[=:]\\s{0,3}[\"']?)?", 0))
            .when(kind == "iban", F.substring(found, 1, 2))
            .otherwise(F.lit(""))
        )
        return {"head": out}

    def rest(e: Column) -> dict:
        found, kind = e["found"], e["kind"]
        body = F.substring(found, F.length(e["head"]) + 1, F.length(found))
        script = F.when(found.rlike(" \\p{IsCyrillic}"), "cyrillic").when(found.rlike(" \\p{IsGreek}"), "greek").otherwise("latin")
        gender = F.when(found.rlike("^(?:" + "|".join(TITLES["f"]) + ")\\.? "), "f").otherwise("m")
        solid = F.regexp_replace(F.lower(found), "[^\\p{L}\\p{N}]", "")
        # the plus of a phone says that a country code follows, however it is set off
        key = F.when((kind == "phone") & found.startswith("+"), F.concat(F.lit("+"), solid)).when(kind.isin("card", "ssn", "phone", "iban"), solid).otherwise(F.lower(body))
        return {"type": F.when(kind == "name", F.concat(F.lit("name:"), gender, F.lit(":"), script)).otherwise(kind), "key": key, "body": body}

    found = F.transform(hits, lambda h: F.struct(h.alias("found")))
    return F.transform(
        chained(found, (["found"], kind), (["found", "kind"], head), (["found", "kind", "head"], rest)),
        lambda e: F.struct(e["type"].alias("type"), e["key"].alias("key"), e["head"].alias("head"), e["body"].alias("body")),
    )


def _byte(stream: Column, i: Column | int) -> Column:
    """The i-th of the stream's 128 bytes, over and over."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substring(stream, (i % 128) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of(options: list[str], b: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), b % len(options))


def _luhn(digits: Column) -> Column:
    """The digits with a last one that makes the Luhn sum a multiple of ten."""
    n = F.size(digits)
    total = F.aggregate(
        F.transform(
            digits,
            lambda d, i: F.when(i == n - 1, F.lit(0)).otherwise(
                F.when((n - i) % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int"))
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.concat(F.slice(digits, F.lit(1), n - 1), F.array(((10 - total % 10) % 10).cast("string")))


def surrogates(items: Column, secret: str) -> Column:
    """Adds new, the attempt-th candidate of each struct (type, key, attempt, ...): for names a full name, for addresses an address, else key with its letters and digits replaced."""
    own = ["type", "key", "attempt"]

    def stream(e: Column) -> dict:
        seed = F.concat_ws("\x1f", F.lit(secret), e["type"], e["key"], e["attempt"].cast("string"))
        # what stays: an email's last label, an IBAN's country (the first two of its key), a phone's plus and country code
        code = F.when(e["attempt"] < CODE_ATTEMPTS, F.length(F.regexp_extract(e["key"], CODE, 0))).otherwise(F.lit(0))
        kept_from = F.when(e["type"] == "email", F.length(e["key"]) - F.length(F.substring_index(e["key"], ".", -1))).otherwise(F.lit(1 << 30))
        return {
            "stream": F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("\x1f")), 512)),
            "chars": F.split(e["key"], ""),
            "from": kept_from,
            "to": F.when(e["type"] == "iban", F.lit(2)).when(e["type"] == "phone", code).otherwise(F.lit(0)),
            "hex": (e["type"] == "secret") & e["key"].rlike("^[0-9a-f]+$"),
        }

    def swapped(e: Column, c: Column, i: Column) -> Column:
        b = _byte(e["stream"], i)
        out = c
        for script, test in (("latin", "\\p{L}"), ("cyrillic", "\\p{IsCyrillic}"), ("greek", "\\p{IsGreek}")):
            out = F.when(c.rlike(test), F.substring(F.lit(LETTERS[script]), b % len(LETTERS[script]) + 1, F.lit(1))).otherwise(out)
        out = F.when(c.rlike("^[0-9]$"), (b % 10).cast("string")).when(c.rlike("^[a-z]$"), F.char(b % 26 + 97)).otherwise(out)
        return F.when((i >= e["from"]) | (i < e["to"]), c).when(e["hex"], F.substring(F.lit("0123456789abcdef"), b % 16 + 1, F.lit(1))).otherwise(out)

    def plain(e: Column) -> dict:
        letters = ~e["type"].startswith("name:") & (e["type"] != "ip")
        return {"plain": F.when(letters, F.transform(e["chars"], lambda c, i: swapped(e, c, i)))}

    def longer(e: Column, syllables: list[str]) -> Column:
        # one syllable more every LONGER attempts, so that there are always surnames left
        more = F.transform(F.sequence(F.lit(1), F.floor(e["attempt"] / LONGER).cast("int")), lambda j: _of(syllables, _byte(e["stream"], j + 4)))
        return F.when(e["attempt"] < LONGER, "").otherwise(F.array_join(more, ""))

    def new(e: Column) -> dict:
        address = F.concat_ws(".", (_byte(e["stream"], 0) % 222 + 1).cast("string"), *[_byte(e["stream"], i).cast("string") for i in (1, 2, 3)])
        valid = F.array_join(_luhn(e["chars"]), "") == e["key"]
        out = F.when(e["type"] == "ip", address).when((e["type"] == "card") & valid, F.array_join(_luhn(e["plain"]), "")).otherwise(F.array_join(e["plain"], ""))
        for (gender, script), names in GIVEN.items():
            family = F.concat(*[_of(SYLLABLES[script], _byte(e["stream"], i)) for i in (1, 2, 3, 4)], longer(e, SYLLABLES[script]))
            full = F.when(F.instr(e["key"], " ") > 0, F.concat(_of(names, _byte(e["stream"], 0)), F.lit(" "), family)).otherwise(family)
            out = F.when(e["type"] == f"name:{gender}:{script}", F.lower(full)).otherwise(out)
        return {"new": out}

    more = ["stream", "chars", "from", "to", "hex"]
    return chained(items, (own + ["head", "body"], stream), (own + ["head", "body"] + more, plain), (own + ["head", "body"] + more + ["plain"], new))


def rendered(items: Column) -> Column:
    """The surrogates in the form of their matches: head, separators and case."""
    own = ["type", "head", "body", "new"]

    def sizes(e: Column) -> dict:
        return {"solid": F.regexp_replace(e["new"], "[^\\p{L}\\p{N}]", ""), "n": F.length(F.regexp_replace(e["body"], "[^\\p{L}\\p{N}]", ""))}

    def tail(e: Column) -> dict:
        # letters and digits of the surrogate that the body stands for: the last ones, as the head holds the first
        return {"tail": F.substring(e["solid"], F.length(e["solid"]) - e["n"] + 1, e["n"])}

    def filled(e: Column) -> dict:
        def put(a: Column, c: Column) -> Column:
            x = F.substring(e["tail"], a["at"], F.lit(1))
            solid = c.rlike("[\\p{L}\\p{N}]")
            return F.struct(
                F.concat(a["out"], F.when(~solid, c).when(c.rlike("\\p{Lu}"), F.upper(x)).otherwise(x)).alias("out"),
                (a["at"] + solid.cast("int")).alias("at"),
            )

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
        return {"filled": F.aggregate(F.split(e["body"], ""), start, put, lambda a: a["out"])}

    done = chained(items, (own, sizes), (own + ["solid", "n"], tail), (own + ["tail"], filled))
    return F.transform(
        done,
        lambda e: F.when(
            e["type"].startswith("name:"),
            F.concat(e["head"], F.when((e["body"] == F.upper(e["body"])) & (F.length(e["body"]) > 1), F.upper(e["new"])).otherwise(F.initcap(e["new"]))),
        )
        .when(e["type"] == "ip", e["new"])
        .otherwise(F.concat(e["head"], e["filled"])),
    )


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _found, the entities of each text in order."""
    hits = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    df = docs.withColumn("_hits", F.coalesce(hits, F.array().cast("array<string>")))
    return df.withColumn("_found", entities_of(F.col("_hits")))


def candidate(attempt: Column, secret: str) -> Column:
    """The candidate surrogate of the row's type and key."""
    one = F.struct(F.col("type").alias("type"), F.col("key").alias("key"), attempt.alias("attempt"), F.lit("").alias("head"), F.lit("").alias("body"))
    return F.get(surrogates(F.array(one), secret), F.lit(0))["new"]


def assign(entities: DataFrame, secret: str, most: int = 100) -> DataFrame:
    """(type, key, attempt) over all distinct entities such that no two entities of a kind share a surrogate and none is an entity itself.

    entities: distinct (type, key). Each round recomputes only what clashed. Names get longer by attempts; a space of fixed digits or letters that is too small for its entities raises.
    """
    known = entities.select("type", "key")
    state = store(known.withColumn("attempt", F.lit(0)).withColumn("new", candidate(F.lit(0), secret)), "pii")
    for attempt in range(1, most + 1):
        rank = F.row_number().over(Window.partitionBy("type", "new").orderBy("attempt", "key"))
        real = known.select(F.col("type"), F.col("key").alias("new"), F.lit(True).alias("_real"))
        judged = state.withColumn("_rank", rank).join(real, ["type", "new"], "left")
        clash = (F.col("_rank") > 1) | F.coalesce("_real", F.lit(False))
        judged = store(judged.select("type", "key", "attempt", "new", clash.alias("_clash")), "pii")
        if judged.where("_clash").isEmpty():
            return state.select("type", "key", "attempt")
        again = judged.where("_clash").select("type", "key").withColumn("attempt", F.lit(attempt)).withColumn("new", candidate(F.lit(attempt), secret))
        state = store(judged.where("not _clash").select("type", "key", "attempt", "new").unionByName(again), "pii")
    raise ValueError("an entity type has more entities than surrogates")


def replace_pii(docs: DataFrame, secret: str, text: str = "text", inline_limit: int = 2_000) -> DataFrame:
    """docs with text rewritten, n_entities and entity_types."""
    found = find(docs.select(F.col(text).alias("t")), "t").select(F.explode("_found").alias("e"))
    entities = store(found.select("e.type", "e.key").distinct(), "pii")
    later = assign(entities, secret).where("attempt > 0")
    own = [f"_own_{i}" for i in range(len(docs.columns))]
    names = list(docs.columns)
    df = find(docs.toDF(*own), own[names.index(text)])
    body = own[names.index(text)]

    def finish(df: DataFrame, attempts: Column) -> DataFrame:
        tried = F.transform(
            "_found",
            lambda e: F.struct(
                e["type"].alias("type"),
                e["key"].alias("key"),
                F.coalesce(F.try_element_at(attempts, F.concat(e["type"], F.lit("\x1f"), e["key"])), F.lit(0)).alias("attempt"),
                e["head"].alias("head"),
                e["body"].alias("body"),
            ),
        )
        df = df.withColumn("_new", F.when(F.size("_found") > 0, rendered(surrogates(tried, secret))))
        df = df.withColumn("_between", F.when(F.size("_found") > 0, F.split(body, ANY, -1)))
        woven = F.concat_ws("", F.transform("_between", lambda s, i: F.concat(s, F.coalesce(F.get(F.col("_new"), i), F.lit("")))))
        columns = [F.when(F.size("_found") > 0, woven).otherwise(F.col(n)).alias(c) if n == body else F.col(n).alias(c) for n, c in zip(own, names, strict=True) if c not in ("n_entities", "entity_types")]
        return df.select(*columns, F.size("_found").cast("long").alias("n_entities"), F.array_sort(F.array_distinct(F.transform("_found", lambda e: e["type"]))).alias("entity_types"))

    rows = later.limit(inline_limit + 1).collect()
    if len(rows) <= inline_limit:
        pairs = [x for r in rows for x in (F.lit(r["type"] + "\x1f" + r["key"]), F.lit(r["attempt"]))]
        attempts = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")
        return finish(df, attempts)
    # too many to inline: documents with entities are written once with a row number, and joined by their entities
    held = store(df.where(F.size("_found") > 0).withColumn("_row", F.monotonically_increasing_id()), "pii-docs")
    one = held.select("_row", F.explode(F.array_distinct(F.transform("_found", lambda e: F.struct(e["type"].alias("type"), e["key"].alias("key"))))).alias("e"))
    maps = one.select("_row", "e.type", "e.key").join(later, ["type", "key"]).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.col("type"), F.lit("\x1f"), F.col("key")), F.col("attempt")))).alias("_attempts"))
    empty = F.create_map().cast("map<string,int>")
    with_maps = held.join(maps, "_row", "left").withColumn("_attempts", F.coalesce("_attempts", empty))
    return finish(with_maps, F.col("_attempts")).unionByName(finish(df.where(F.size("_found") == 0), empty))


def op2_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs, "surrogate-key-1")
