"""Resume documents: paging, views of one document, and batches of changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom import dimensions, schemas
from fieldloom.functions import documents as docs
from fieldloom.operators.lookup import owned_resumes
from fieldloom.operators.skew import PROBE, Running, SkewPolicy, Timeline, shared, skew_join


@dataclass(frozen=True)
class Changes:
    resumes: DataFrame    # the next state
    verdicts: DataFrame   # requests with their verdict


def resume_page(resumes: DataFrame, skip: int = 0, limit: int = schemas.DEFAULT_PAGE_SIZE,
                newest_by: str = "updated_at") -> DataFrame:
    """Per user the resumes skip+1..skip+limit, newest first, as list items."""
    if skip < 0 or not 1 <= limit <= schemas.MAX_PAGE_SIZE:
        raise ValueError(f"need skip >= 0 and 1 <= limit <= {schemas.MAX_PAGE_SIZE}")
    shown = ("resume_id", "user_id", "title")
    items = resumes.select(*shown, docs.field_count(F.col("fields")).alias("field_count"),
                           *[c for c in [newest_by] if c not in shown])
    newest = [F.desc_nulls_last(newest_by), F.col("resume_id")]
    # map tasks forward a page of each user only, so a user's many resumes need no blocks unless the page is huge
    few = skip + limit <= SkewPolicy.of(resumes.sparkSession).pieceRows
    ranked = Timeline(items, ["user_id"], newest, None if few else PROBE).numbered("position").rows()
    page = ranked.filter((F.col("position") <= skip + limit) & (F.col("position") > skip))
    return page.withColumn("position", F.col("position").cast("int"))


def search_resumes(resumes: DataFrame, key: str, needle: str) -> DataFrame:
    return resumes.filter(docs.field_contains(F.col("fields"), key, needle))


def entries(resumes: DataFrame) -> DataFrame:
    """One row per document key, in document order."""
    return resumes.select("resume_id", F.posexplode(F.map_entries("fields")).alias("pos", "entry")).select(
        "resume_id", "pos", F.col("entry.key").alias("key"), F.col("entry.value").alias("value"))


def fields_with_preset(resumes: DataFrame) -> DataFrame:
    """Document keys with their preset group, label and required flag; the fixed dimension is 25 rows."""
    preset = dimensions.preset_fields(resumes.sparkSession).select("key", "group", "label", "required")
    return entries(resumes).join(F.broadcast(preset), "key", "left").select(
        "resume_id", "pos", "key", "value", "group", "label", "required")


def categorised(fields: Column) -> Column:
    """Group to its part of the document: all preset groups, then the rest if any.

    A document without fields gives an empty map.
    """
    def part(keys: Sequence[str]) -> Column:
        return F.map_filter(fields, lambda k, v: k.isin(*keys))

    groups = F.map_from_arrays(
        F.array(*[F.lit(g) for g in dimensions.PRESET_KEYS]),
        F.array(*[part(keys) for keys in dimensions.PRESET_KEYS.values()]))
    rest = F.map_filter(fields, lambda k, v: ~k.isin(*dimensions.ALL_PRESET_KEYS))
    with_rest = F.when(F.size(rest) > 0, F.map_concat(groups, F.create_map(F.lit(dimensions.OTHER_GROUP), rest)))
    empty = F.create_map().cast("map<string,map<string,string>>")
    return F.when(F.size(fields) > 0, F.coalesce(with_rest, groups)).otherwise(empty)


def fields_by_category(resumes: DataFrame) -> DataFrame:
    """The categorised document in long form, one row per group; a group may be empty."""
    return resumes.select("resume_id", F.explode(categorised(F.col("fields"))).alias("group", "members"))


def preset_coverage(resumes: DataFrame) -> DataFrame:
    """Per resume and preset group: keys present, and required keys missing."""
    preset = dimensions.PRESET_GROUPS
    rows = F.array(*[
        F.struct(
            F.lit(group).alias("group"), F.lit(len(members)).alias("n_preset"),
            _how_many([k for k, _, _ in members]).alias("n_present"),
            (F.lit(sum(r for _, _, r in members)) - _how_many([k for k, _, r in members if r])).alias("required_missing"),
        ) for group, _, members in preset])
    return resumes.select("resume_id", F.inline(rows))


def _how_many(keys: Sequence[str]) -> Column:
    if not keys:
        return F.lit(0)
    return F.size(F.array_intersect(F.map_keys("fields"), F.array(*[F.lit(k) for k in keys])))


def preset_usage(resumes: DataFrame) -> DataFrame:
    """Each preset field with the number of resumes that fill it; counted before joining."""
    used = (resumes.select(F.explode(F.map_keys("fields")).alias("key"))
            .filter(F.col("key").isin(*dimensions.ALL_PRESET_KEYS))
            .groupBy("key").agg(F.count(F.lit(1)).alias("n_resumes")))
    return (dimensions.preset_fields(resumes.sparkSession).join(F.broadcast(used), "key", "left")
            .withColumn("n_resumes", F.coalesce("n_resumes", F.lit(0))))


def create_resumes(resumes: DataFrame, requests: DataFrame) -> DataFrame:
    """Append new resumes; created_at and updated_at are the request's time."""
    stamped = requests.withColumns({
        "created_at": F.col("requested_at"), "updated_at": F.col("requested_at"),
        "fields": F.coalesce("fields", docs.no_fields())})
    return resumes.unionByName(stamped.select(*resumes.columns))


def _owned_verdicts(requests: DataFrame, resumes: DataFrame) -> DataFrame:
    verdict = F.when(F.col("found"), "ok").otherwise("not_found")
    return owned_resumes(requests, resumes, []).select(*requests.columns, verdict.alias("verdict"))


_LATEST = ("requested_at", "request_id")


def update_resumes(resumes: DataFrame, requests: DataFrame) -> Changes:
    """Replace title and/or the whole document; the latest request that sets a part wins.

    has_title and has_fields tell a part that is set to null from one not set.
    """
    def latest(column: str) -> Column:
        value = F.struct(F.col(column).alias("v"))
        return F.max_by(F.when(F.col(f"has_{column}"), value),
                        F.when(F.col(f"has_{column}"), F.struct(*_LATEST)))

    patches = requests.groupBy("resume_id", "user_id").agg(
        latest("title").alias("_title"), latest("fields").alias("_fields"),
        # a request that sets neither part changes nothing and leaves no stamp
        F.max(F.when(F.col("has_title") | F.col("has_fields"), F.col("requested_at"))).alias("_at"))
    state = resumes.join(patches, ["resume_id", "user_id"], "left").withColumns({
        "title": F.when(F.col("_title").isNotNull(), F.col("_title.v")).otherwise(F.col("title")),
        "fields": F.when(F.col("_fields").isNotNull(), F.coalesce("_fields.v", docs.no_fields()))
                   .otherwise(F.col("fields")),
        **touched(resumes, F.col("_at")),
    }).select(*resumes.columns)
    return Changes(state, _owned_verdicts(requests, resumes))


def touched(state: DataFrame, at: Column) -> dict[str, Column]:
    """Stamp updated_at on changed rows, where the table has the column."""
    if "updated_at" not in state.columns:
        return {}
    return {"updated_at": F.coalesce(at, F.col("updated_at"))}


def delete_resumes(resumes: DataFrame, requests: DataFrame) -> Changes:
    """Remove owned resumes; the first request finds it, later ones do not."""
    wanted = requests.groupBy("resume_id", "user_id").agg(F.min(F.struct(*_LATEST)).alias("first"))
    owned = shared(wanted.join(resumes.select("resume_id", "user_id"), ["resume_id", "user_id"], "left_semi"))
    survivors = resumes.join(owned.select("resume_id", "user_id"), ["resume_id", "user_id"], "left_anti")
    done = owned.select(F.col("first.request_id").alias("request_id"), F.lit(True).alias("_done"))
    verdict = F.when(F.col("_done"), "ok").otherwise("not_found")
    verdicts = requests.join(done, "request_id", "left").select(*requests.columns, verdict.alias("verdict"))
    return Changes(survivors, verdicts)


def edit_fields(resumes: DataFrame, edits: DataFrame) -> Changes:
    """Apply merges (``patch``) and single-key deletes (``field_key``) in time order.

    An edit has one of the two set. One window per (resume, key) tells each
    step whether the key was set before it; that reduces to the last value, the
    place where the key was last set anew, and the last change. Only then is
    one patch per resume put together, whose size is the number of distinct
    keys. Keys keep the place a sequence of single edits would give them.
    """
    resume = ["resume_id", "user_id"]
    is_merge = F.col("patch").isNotNull()
    verdicts = _owned_verdicts(edits, resumes).withColumn(
        "verdict", F.when(is_merge & (F.size("patch") == 0), "empty_patch").otherwise(F.col("verdict")))

    entry = "struct<key:string,value:string>"
    steps = edits.select(
        *resume, "request_id", "requested_at",
        F.posexplode(F.when(is_merge, F.map_entries("patch")).otherwise(
            F.array(F.struct(F.col("field_key").alias("key"), F.lit(None).cast("string").alias("value")))
            .cast(f"array<{entry}>"))).alias("pos", "entry"),
        is_merge.alias("is_set"),
    ).select(*resume, "requested_at", "request_id", "pos", F.col("entry.key").alias("key"),
             F.col("entry.value").alias("value"), "is_set")
    per_key, order = [*resume, "key"], ["requested_at", "request_id", "pos"]
    ordered = (Timeline(steps, per_key, order)
               .running(Running("_before", F.max, F.struct(*order, "is_set"), inclusive=False)).rows())
    is_set, follows_set, at = F.col("is_set"), F.coalesce("_before.is_set", F.lit(False)), F.col("requested_at")
    held = resumes.select(*resume, F.explode(F.map_keys("fields")).alias("key"), F.lit(True).alias("_held"))
    reduced = ordered.groupBy(*per_key).agg(
        F.max(F.struct(*order, "is_set", "value")).alias("_last"),
        # a key stands where it was set and not there before
        F.max(F.when(is_set & ~follows_set, F.struct(*order))).alias("place"),
        F.bool_or(~is_set).alias("_deleted"),
        F.max(F.when(is_set | follows_set, at)).alias("_changed_at"),
        # a first step that deletes counts when the document holds the key
        F.max(F.when(~is_set & F.col("_before").isNull(), at)).alias("_first_at"),
    ).join(held, per_key, "left")
    patches = reduced.groupBy(*resume).agg(
        F.collect_list(F.when(F.col("_last.is_set"), F.struct("place", "key", F.col("_last.value").alias("value"))))
        .alias("_sets"),
        # keys the document holds: its size bounds the list
        F.collect_list(F.when(F.col("_deleted") & F.col("_held"), F.col("key"))).alias("_dropped"),
        F.max(F.greatest("_changed_at", F.when(F.col("_held"), F.col("_first_at")))).alias("_at"),
    )
    patch = F.map_from_entries(F.transform(
        F.array_sort("_sets"), lambda s: F.struct(s["key"], s["value"])))
    fields = docs.merged(docs.without_any(F.col("fields"), F.col("_dropped")), patch)
    # a delete of an absent key leaves the document, and with it the stamp, alone
    state = (
        resumes.join(patches, resume, "left")
        .withColumn("_next", F.when(F.col("_sets").isNull(), F.col("fields")).otherwise(fields))
        .withColumns({"fields": F.col("_next"), **touched(resumes, F.col("_at"))})
        .select(*resumes.columns)
    )
    return Changes(state, verdicts)


def split_stored(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Resumes with parsed documents, and the raw rows whose document is not a JSON object."""
    broken = docs.is_broken(F.col("fields"))
    return raw.filter(~broken).withColumn("fields", docs.parse_document(F.col("fields"))), raw.filter(broken)


def edit_stored(raw: DataFrame, edits: DataFrame) -> Changes:
    """``edit_fields`` on resumes whose documents are JSON text, which stay text.

    A broken document is in quarantine: it stays byte for byte as it is, and
    edits of it are refused with ``corrupt_document``.
    """
    sound, broken = split_stored(raw)
    changes = edit_fields(sound, edits)
    held = broken.select("resume_id", "user_id", F.lit(True).alias("_broken"))
    verdict = F.when(F.col("_broken") & (F.col("verdict") == "not_found"), "corrupt_document").otherwise(F.col("verdict"))
    verdicts = (skew_join(changes.verdicts, held, ["resume_id", "user_id"], "left", ["request_id"])
                .withColumn("verdict", verdict).select(*changes.verdicts.columns))
    written = changes.resumes.withColumn("fields", docs.document_text(F.col("fields")))
    return Changes(written.unionByName(broken), verdicts)


def migrate_resumes(legacy: DataFrame, backfill: bool = False) -> DataFrame:
    """The four-document layout to title and fields.

    The plain migration starts from empty documents; backfill merges the four,
    later ones winning on a shared key.
    """
    parts = ("personal_info", "education", "experience", "skills")
    fields = docs.no_fields()
    if backfill:
        for part in parts:
            fields = docs.merged(fields, docs.parse_document(F.col(part)))
    return legacy.select(
        *[c for c in legacy.columns if c not in parts],
        F.lit(None).cast("string").alias("title"), fields.alias("fields"))
