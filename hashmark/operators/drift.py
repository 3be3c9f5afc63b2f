"""Schemas that drift between files: a catalogue of field lifespans, the changes, and one consistent table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hashmark.functions.ids import game_key, team_aliases
from hashmark.session import Kept, cut

#: Fields that name the record and never change.
RECORD_ID = ("game_id", "play_id")

#: JSON types as they are told apart, commonest first where counts tie.
KINDS = ["boolean", "integer", "double", "string"]

#: The spellings under which producers deliver a field, and the type of the consistent table.
ALIASES = {
    "season": ("int", ["season", "season_year", "season_no", "yr"]),
    "play_type": ("string", ["play_type", "play_kind", "ptype"]),
    "week": ("int", ["week", "week_no", "wk"]),
    "posteam": ("string", ["posteam", "offense"]),
    "down": ("int", ["down", "down_no", "dwn"]),
    "ydstogo": ("int", ["ydstogo", "yards_to_go", "togo"]),
    "yardline_100": ("int", ["yardline_100", "yd_line"]),
    "yards_gained": ("int", ["yards_gained", "gain"]),
    "air_yards": ("double", ["air_yards", "ay"]),
    "epa": ("double", ["epa", "exp_points_added"]),
    "wp": ("double", ["wp", "win_prob", "wp_home"]),
    "shotgun": ("boolean", ["shotgun", "is_shotgun", "sg"]),
    "no_huddle": ("boolean", ["no_huddle", "hurry_up"]),
    "passer_player_id": ("string", ["passer_player_id", "passer_id"]),
    "temp": ("double", ["temp", "temp_f", "temperature"]),
    "wind": ("double", ["wind", "wind_speed", "wind_mph"]),
    "roof": ("string", ["roof", "roof_type"]),
}


def folded(name: str) -> str:
    """A spelling by its letters and digits alone."""
    return "".join(ch for ch in name.lower() if ch.isalnum())


def records(stg: DataFrame, dim_team: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every record that parses as a JSON object, as a variant, with the game it names and its play id as text; of other columns only ``keep``."""
    parsed = stg.withColumn("record", F.try_parse_json("raw_record")).where(F.schema_of_variant("record").startswith("OBJECT"))
    return parsed.select(
        "feed_name",
        "file_name",
        "delivered_at",
        "line_no",
        "record",
        *keep,
        game_key(F.try_variant_get("record", "$.game_id", "string"), team_aliases(dim_team)).alias("game"),
        F.btrim(F.try_variant_get("record", "$.play_id", "string"), F.lit(" \t")).alias("play"),
    )


def field_values(recs: DataFrame) -> DataFrame:
    """One row per record and field: its name, kind (null for a JSON null), value as text and place in the record.

    A record without fields has one row without field name, so that it can be counted.
    """
    raw = recs.lateralJoin(recs.sparkSession.tvf.variant_explode(F.col("record").outer()))
    shape = F.schema_of_variant("value")
    # a decimal point of a lesser number is lost in its shape
    integral = (shape == "BIGINT") | (shape.startswith("DECIMAL") & shape.rlike(r"^DECIMAL\((19|[23]\d),0\)$"))
    kind = (
        F.when(shape == "VOID", F.lit(None).cast("string"))
        .when(shape == "BOOLEAN", "boolean")
        .when(integral, "integer")
        .when(shape.isin("DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "double")
        .otherwise("string")
    )
    return raw.select(
        "feed_name", "file_name", "game", "play", F.coalesce("pos", F.lit(0)).alias("pos"), F.col("key").alias("field"), kind.alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("value")
    )


def files(stg: DataFrame) -> DataFrame:
    """Each file with its place in its feed, by delivery (then name): ``seq`` from 1, and the feed's last."""
    each = stg.groupBy("feed_name", "file_name").agg(F.min("delivered_at").alias("delivered_at"))
    by_feed = Window.partitionBy("feed_name")
    return each.withColumn("seq", F.row_number().over(by_feed.orderBy("delivered_at", "file_name"))).withColumn("last_seq", F.max("seq").over(by_feed))


def catalogue(values: DataFrame, order: DataFrame) -> DataFrame:
    """The footer metadata of the files: one row per file and field that belongs to it, with its type.

    A field belongs if at least half of the file's records carry it. Its type is the commonest kind of its
    values; where all are null it keeps the type it had in the files just before. ``order`` is ``files(...)``.
    """
    counted = values.groupBy("feed_name", "file_name", "field").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == 0).alias("n_first"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    )
    counted = counted.withColumn("n_records", F.sum("n_first").over(Window.partitionBy("feed_name", "file_name")))
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS])
    own = F.coalesce(*[F.when((most > 0) & (F.col(f"n_{k}") == most), k) for k in KINDS])
    there = counted.where(F.col("field").isNotNull() & ~F.col("field").isin(*RECORD_ID) & (2 * F.col("n") >= F.col("n_records"))).join(order, ["feed_name", "file_name"])
    by_field = Window.partitionBy("feed_name", "field").orderBy("seq")
    island = there.withColumn("island", F.col("seq") - F.row_number().over(by_field))
    so_far = Window.partitionBy("feed_name", "field", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("type", F.last(own, ignorenulls=True).over(so_far)).select("feed_name", "file_name", "seq", "last_seq", "field", "island", "type")


def lifespans(cat: DataFrame) -> DataFrame:
    """Unbroken stretches of files of a feed in which a field has one type: where each starts and ends."""
    by_field = Window.partitionBy("feed_name", "field", "type").orderBy("seq")
    stretch = cat.withColumn("stretch", F.col("seq") - F.row_number().over(by_field))
    return stretch.groupBy("feed_name", "field", "type", "stretch").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("n_files")).drop("stretch")


def _edges(cat: DataFrame) -> DataFrame:
    """Catalogue rows with what lag and lead say: whether the field starts here, whether it is gone in the next file."""
    by_field = Window.partitionBy("feed_name", "field").orderBy("seq")
    before, after = F.lag("seq").over(by_field), F.lead("seq").over(by_field)
    return cat.select(
        "*",
        ((F.col("seq") > 1) & ~(before.eqNullSafe(F.col("seq") - 1))).alias("starts"),
        ((F.col("seq") < F.col("last_seq")) & ~(after.eqNullSafe(F.col("seq") + 1))).alias("ends"),
        F.when(before == F.col("seq") - 1, F.lag("type").over(by_field)).alias("former_type"),
    )


class Drift(NamedTuple):
    """What the files say of their fields: ``order`` of the files, the ``cat``alogue with its edges, fields that are ``born`` and ``gone``
    at a file, those ``renamed`` (all that fit), and of each that appeared its best former name (``heirs``)."""

    order: DataFrame
    cat: DataFrame
    born: DataFrame
    gone: DataFrame
    renamed: DataFrame
    heirs: DataFrame


def study(stg: DataFrame, dim_team: DataFrame) -> Drift:
    """Catalogue the files' fields, and prove renames by the values of plays that neighbouring files share.

    All records are read once for the catalogue; only the files at which some field vanished and another appeared are
    read again, and of their records only those fields.
    """
    order = cut(files(stg))
    cat = cut(_edges(catalogue(field_values(records(stg, dim_team)), order)))
    born = cat.where("starts").select("feed_name", "seq", F.col("field").alias("new"), F.col("island").alias("new_island"), F.col("type").alias("new_type"))
    gone = cat.where("ends").select("feed_name", (F.col("seq") + 1).alias("seq"), F.col("field").alias("old"), F.col("island").alias("old_island"), F.col("type").alias("old_type"))

    pairs = born.join(gone, ["feed_name", "seq"])
    asked = (
        pairs.select("feed_name", "seq", F.col("seq").alias("at_seq"), F.col("new").alias("field"), F.lit(True).alias("is_new"))
        .unionByName(pairs.select("feed_name", "seq", (F.col("seq") - 1).alias("at_seq"), F.col("old").alias("field"), F.lit(False).alias("is_new")))
        .groupBy("feed_name", "at_seq")
        .agg(F.collect_set(F.struct("seq", "is_new", "field")).alias("asked"))
        .join(order.select("feed_name", F.col("seq").alias("at_seq"), "file_name"), ["feed_name", "at_seq"])
        .select("feed_name", "file_name", "asked")
    )
    read_again = records(stg.join(cut(asked), ["feed_name", "file_name"]), dim_team, ("asked",)).where(F.col("game").isNotNull() & F.col("play").isNotNull())
    each = read_again.select("feed_name", "game", "play", F.expr("cast(record AS MAP<STRING, VARIANT>)").alias("held"), F.explode("asked").alias("a"))
    value = F.expr("try_variant_get(try_element_at(held, a.field), '$', 'string')")
    found = each.select("feed_name", "a.*", "game", "play", F.btrim(value, F.lit(" \t\r\n")).alias("value")).where("value IS NOT NULL").distinct()
    held = cut(found)
    news = held.where("is_new").drop("is_new").withColumnsRenamed({"field": "new", "value": "new_value"})
    olds = held.where("NOT is_new").drop("is_new").withColumnsRenamed({"field": "old", "value": "old_value"})
    same = (F.col("new_value") == F.col("old_value")) | (F.col("new_value").try_cast("double") == F.col("old_value").try_cast("double"))
    renamed = cut(
        news.join(olds, ["feed_name", "seq", "game", "play"])
        .groupBy("feed_name", "seq", "new", "old")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_unlike"))
        .where("n_unlike = 0")
        .join(born, ["feed_name", "seq", "new"])
        .join(gone, ["feed_name", "seq", "old"])
    )
    best = Window.partitionBy("feed_name", "seq", "new").orderBy(F.desc("n"), "old")
    heirs = renamed.withColumn("rank", F.row_number().over(best)).where("rank = 1").withColumn("new_type", F.coalesce("new_type", "old_type"))
    return Drift(order, cat, born, gone, renamed, heirs)


def changes(stg: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``feed_name``, ``file_name``, ``change_kind``, ``field_name``, ``former_name``, ``former_type``, ``type``.

    Renames are proven by values: the field that vanished and the one that appeared hold the same, as text or
    as numbers, in every play that both files give a value for, and there is at least one. Where several
    vanished fields fit one that appeared, all of them count as renamed and the one seen in most plays (then the least name) is its
    former name. A type not known so far (nothing but nulls) is no change of type.
    """
    order, cat, born, gone, renamed, heirs = study(stg, dim_team)
    c, none = F.col, F.lit(None).cast("string")

    def entries(df: DataFrame, kind: str, field: Column, former: Column = none, former_type: Column = none, new_type: Column = none) -> DataFrame:
        of = {"field_name": field, "former_name": former, "former_type": former_type, "type": new_type}
        return df.select("feed_name", "seq", F.lit(kind).alias("change_kind"), *[x.alias(n) for n, x in of.items()])

    log = [
        entries(heirs, "renamed", c("new"), c("old"), c("old_type"), c("new_type")),
        entries(born.join(renamed, ["feed_name", "seq", "new"], "left_anti"), "added", c("new"), new_type=c("new_type")),
        entries(gone.join(renamed, ["feed_name", "seq", "old"], "left_anti"), "removed", c("old"), former_type=c("old_type")),
        entries(cat.where("former_type <> type"), "retyped", c("field"), c("field"), c("former_type"), c("type")),
        entries(heirs.where("old_type <> new_type"), "retyped", c("new"), c("old"), c("old_type"), c("new_type")),
    ]
    named = order.select("feed_name", "seq", "file_name")
    return reduce(DataFrame.unionByName, log).join(named, ["feed_name", "seq"]).drop("seq")


def change_cases(stg: DataFrame, dim_team: DataFrame) -> DataFrame:
    """``file_name``, ``change_kind``, ``field_name``: each file against the one before it in its feed."""
    return changes(stg, dim_team).select("file_name", "change_kind", "field_name")


def _typed(c: Column, kind: str) -> Column:
    text = F.btrim(c, F.lit(" \t\r\n"))
    if kind == "int":
        number = text.try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "y", "yes", "t", "1"), True).when(F.lower(text).isin("false", "n", "no", "f", "0"), False)
    return text.try_cast(kind)


def label(c: Column) -> Column:
    """A play type as one label whatever its spelling: trimmed, lower case, blanks and hyphens as ``_``."""
    return F.nullif(F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n"))), r"[\s-]+", "_"), F.lit(""))


def _known_field(name: Column, aliases: dict[str, tuple[str, list[str]]]) -> Column:
    """The field of the consistent table that a spelling stands for, letters and digits in any case; null where ``aliases`` lacks it."""
    known = {folded(s): field for field, (_, spelled) in aliases.items() for s in spelled}
    pairs = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    return F.try_element_at(pairs, F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")))


def alias_table(drift: Drift, aliases: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """``feed_name``, ``file_name``, ``field_name``, ``canonical_name``: for each file's fields the one of the consistent table, null where none.

    A field's unbroken stretch of files and the stretches that it was renamed from and to are one field. What it is, is
    said by the spellings of it that ``aliases`` knows (of several the one met first, then the least); a known spelling keeps its own meaning. The
    renames are a forest, in which every stretch finds its root by doubling its steps, so chains of any length take few rounds.
    """
    table = aliases or ALIASES
    node = lambda feed, field, island: F.struct(F.col(feed).alias("feed"), F.col(field).alias("field"), F.col(island).alias("island"))
    steps = drift.heirs.select(node("feed_name", "new", "new_island").alias("node"), node("feed_name", "old", "old_island").alias("up"))
    kept = Kept(drift.cat.sparkSession)
    ups = kept.keep(steps, "ups")
    while True:
        further = ups.alias("a").join(ups.alias("b"), F.col("a.up") == F.col("b.node"), "left")
        ups = kept.keep(further.select("a.node", F.coalesce("b.up", "a.up").alias("up"), F.col("b.up").isNotNull().alias("moved")), "ups")
        if not ups.where("moved").limit(1).count():
            break
        ups = ups.drop("moved")
    stretches = drift.cat.groupBy(node("feed_name", "field", "island").alias("node")).agg(F.min("seq").alias("first_seq"))
    rooted = stretches.join(ups.drop("moved"), "node", "left").select("node", "first_seq", F.coalesce("up", "node").alias("root"), _known_field(F.col("node.field"), table).alias("known"))
    meant = rooted.where("known IS NOT NULL").groupBy("root").agg(F.min_by("known", F.struct("first_seq", "known")).alias("meaning"))
    named = rooted.join(meant, "root", "left").select("node", F.coalesce("known", "meaning").alias("canonical_name"))
    of_file = drift.cat.select("feed_name", "file_name", F.col("field").alias("field_name"), node("feed_name", "field", "island").alias("node"))
    return of_file.join(named, "node").select("feed_name", "file_name", "field_name", "canonical_name")


def proven_aliases(drift: Drift, aliases: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """``feed_name``, ``file_name``, ``_proven`` (spelling to field): what renames prove beyond ``aliases``, for the files that have such."""
    beyond = alias_table(drift, aliases).where(F.col("canonical_name").isNotNull() & _known_field(F.col("field_name"), aliases or ALIASES).isNull())
    return beyond.groupBy("feed_name", "file_name").agg(F.map_from_entries(F.collect_set(F.struct("field_name", "canonical_name"))).alias("_proven"))


def play_type_codes(types: DataFrame) -> DataFrame:
    """What each numeric play type code stands for: the label the same play has most often where it is spelled out.

    ``types``: ``game``, ``play``, ``value``.
    """
    known = types.where("value IS NOT NULL AND game IS NOT NULL AND play IS NOT NULL")
    number = _typed(F.col("value"), "int")
    votes = (
        known.where(number.isNotNull()).groupBy("game", "play", number.alias("code")).agg(F.count(F.lit(1)).alias("m"))
        .join(known.where(F.col("value").try_cast("double").isNull()).groupBy("game", "play", label(F.col("value")).alias("label")).agg(F.count(F.lit(1)).alias("n")), ["game", "play"])
        .groupBy("code", "label")
        .agg(F.sum(F.col("m") * F.col("n")).alias("n"))
    )
    return votes.groupBy("code").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def consistent_plays(stg: DataFrame, dim_team: DataFrame, aliases: dict[str, tuple[str, list[str]]] | None = None) -> DataFrame:
    """All records of all files in one table with one name and type per field of ``aliases``.

    The casts are generated from the alias table: the spellings of ``aliases``, and those that renames prove to be its fields'
    (``proven_aliases``). Of a record's spellings of a field the first that holds a value is taken, those of
    ``aliases`` first, and a value that its type can't hold becomes null. season is an integer, play_type its
    label; numeric codes are resolved by the plays that other files spell out. Fields of no known spelling
    are kept as text in ``other_fields``. Broken records aren't in the table.
    """
    table = aliases or ALIASES
    proven = cut(proven_aliases(study(stg, dim_team), table))
    recs = records(stg.join(proven, ["feed_name", "file_name"], "left"), dim_team, ("_proven",))
    fields = F.expr("transform(map_entries(cast(record AS MAP<STRING, VARIANT>)), e -> struct(lower(regexp_replace(e.key, '[^A-Za-z0-9]', '')) AS fold, e.key AS name, try_variant_get(e.value, '$', 'string') AS value))")
    known = [folded(s) for _, spelled in table.values() for s in spelled] + [folded(x) for x in RECORD_ID]
    row = recs.withColumn("_fields", fields)

    def first(holds: Callable[[Column], Column]) -> Column:
        return F.get(F.filter("_fields", lambda e: holds(e) & e["value"].isNotNull()), 0)["value"]

    def spelled_as(spelling: str) -> Column:
        return first(lambda e: e["fold"] == spelling)

    def of(name: str) -> Column:
        return F.coalesce(*map(spelled_as, dict.fromkeys(map(folded, table[name][1]))), first(lambda e: F.try_element_at("_proven", e["name"]) == name))

    others = F.filter("_fields", lambda e: ~e["fold"].isin(known) & F.try_element_at("_proven", e["name"]).isNull())
    kind_text = F.btrim(of("play_type"), F.lit(" \t\r\n"))
    flat = row.select(
        "feed_name", "file_name", "line_no", "game", "play", *[(kind_text if n == "play_type" else _typed(of(n), table[n][0])).alias(n) for n in table],
        F.map_from_entries(F.transform(others, lambda e: F.struct(e["name"], e["value"]))).alias("other_fields"),
    )
    codes = play_type_codes(flat.select("game", "play", F.col("play_type").alias("value")))
    number, code = F.col("play_type").try_cast("double"), _typed(F.col("play_type"), "int")
    return (
        flat.join(codes.select(F.col("code").alias("_code"), F.col("label").alias("_label")), code == F.col("_code"), "left")
        .withColumn("play_type", F.coalesce("_label", F.when(number.isNull(), label(F.col("play_type")))))
        .drop("_code", "_label")
    )
