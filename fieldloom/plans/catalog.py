"""Every operator as a query over the derived tables of one scale factor."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import documents as docs
from fieldloom.operators import accounts, codes, gate, integrity, lookup, matching, quota, resumes, stats
from fieldloom.plans import match_forms as forms
from fieldloom.session import configure, work_dir
from fieldloom.sources import derived, tables
from fieldloom.streaming import stateful, usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CODE_SEED = "demo"
CODES_AS_OF = "timestamp_ntz '2024-01-01 00:00:00'"
# arrival cuts of the replayed streams: everything before, then everything after
ARRIVAL_CUT = "timestamp_ntz '1996-01-01 00:00:00'"
# longer than the whole of any table's time
ANY_TIME = timedelta(days=100_000)


class Tables:
    """The derived tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        build = getattr(derived, name, None)
        if build is not None and name not in ("view", "dialect"):
            return build(self.spark, self.sf_dir)
        return derived.view(self.spark, self.sf_dir, name)

    def domain(self) -> dict[str, DataFrame]:
        names = ("users", "activation_codes", "resumes", "user_activations", "usage_logs")
        return {name: getattr(self, name) for name in names}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(configure(spark), sf_dir))

    QUERIES[build.__name__] = run
    return build


# --- scans and sinks ---------------------------------------------------------

@query
def scan_users(t: Tables) -> DataFrame:
    return t.users


@query
def scan_resumes(t: Tables) -> DataFrame:
    return t.resumes.select("resume_id", "user_id", "title", docs.field_count(F.col("fields")).alias("n_fields"),
                            F.col("fields")["email"].alias("email"), "updated_seq")


@query
def scan_codes(t: Tables) -> DataFrame:
    return t.activation_codes


@query
def scan_grants(t: Tables) -> DataFrame:
    return t.user_activations


@query
def scan_usage_logs(t: Tables) -> DataFrame:
    return t.usage_logs


@query
def preset_fields(t: Tables) -> DataFrame:
    return resumes.preset_usage(t.resumes)


@query
def field_types(t: Tables) -> DataFrame:
    return stats.field_type_usage(t.form_fields)


@query
def seed_insert(t: Tables) -> DataFrame:
    return tables.insert_if_absent(t.users, tables.users(t.seed_users), "email", ["user_id"])


@query
def append_usage_log(t: Tables) -> DataFrame:
    return _match_forms(t).logs


# --- lookups -----------------------------------------------------------------

@query
def lookup_one_or_none(t: Tables) -> DataFrame:
    state = t.activation_codes.select("code", "code_id", "total_uses")
    return lookup.lookup_one_or_none(t.redeem_requests, state, ["code"])


@query
def owned_resume_lookup(t: Tables) -> DataFrame:
    wanted = t.resume_requests.select("request_id", "resume_id", "user_id")
    return lookup.owned_resumes(wanted, t.resumes.withColumnRenamed("title", "found_title"), ["found_title"])


@query
def active_user_gate(t: Tables) -> DataFrame:
    return lookup.active_user_gate(t.deactivations, t.users)


@query
def login_gate(t: Tables) -> DataFrame:
    return lookup.login_gate(t.registrations.select("request_id", "email"), t.users)


@query
def user_grants(t: Tables) -> DataFrame:
    return lookup.rows_for(t.user_activations, t.redeem_requests, ["user_id"], "activation_id")


@query
def user_code_grants(t: Tables) -> DataFrame:
    asked = lookup.with_code(t.redeem_requests, t.activation_codes)
    return lookup.rows_for(t.user_activations, asked, ["user_id", "code_id"], "activation_id")


@query
def validate_code(t: Tables) -> DataFrame:
    return lookup.validate_codes(t.redeem_requests, t.activation_codes, F.col("requested_at"))


@query
def validate_form_fields(t: Tables) -> DataFrame:
    return matching.validate_form_fields(t.match_requests, t.form_fields)


@query
def check_lengths(t: Tables) -> DataFrame:
    return integrity.check_lengths(t.domain())


@query
def search_resumes_by_field(t: Tables) -> DataFrame:
    return resumes.search_resumes(t.resumes, "hobby", "SRC1").select("resume_id", "user_id")


# --- joins -------------------------------------------------------------------

@query
def requests_with_resume(t: Tables) -> DataFrame:
    return lookup.requests_with_resume(t.match_requests, t.resumes, docs.resume_text(F.col("fields")))


@query
def redeem_with_code(t: Tables) -> DataFrame:
    return lookup.with_code(t.redeem_requests, t.activation_codes)


@query
def already_redeemed(t: Tables) -> DataFrame:
    return lookup.already_redeemed(t.redeem_requests, t.activation_codes, t.user_activations)


@query
def new_emails(t: Tables) -> DataFrame:
    return lookup.new_rows(t.registrations, t.users, "email", "request_id")


@query
def new_codes(t: Tables) -> DataFrame:
    return lookup.new_rows(t.redeem_requests, t.activation_codes, "code", "request_id")


@query
def fields_with_preset(t: Tables) -> DataFrame:
    return resumes.fields_with_preset(t.resumes)


@query
def fk_orphans(t: Tables) -> DataFrame:
    return integrity.fk_orphans(t.domain())


@query
def cascade_delete(t: Tables) -> DataFrame:
    domain = t.domain()
    left = integrity.cascade_delete(
        domain, domain["users"].filter("status = 'banned'"), domain["activation_codes"].filter("status = 'used'"))
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(child).alias("child_table"), F.col(integrity.CHILD_IDS[child]).alias("row_id"))
        for child, df in left.items()])


# --- aggregates --------------------------------------------------------------

@query
def match_stats(t: Tables) -> DataFrame:
    return stats.match_stats(t.usage_logs, t.users)


@query
def remaining_uses(t: Tables) -> DataFrame:
    return stats.remaining_uses(t.user_activations, t.users)


@query
def usage_stats(t: Tables) -> DataFrame:
    return stats.usage_stats(t.user_activations, t.users)


@query
def resume_count(t: Tables) -> DataFrame:
    return stats.resume_count(t.resumes, t.users)


@query
def match_summary(t: Tables) -> DataFrame:
    return matching.match_summary(matching.read_answers(t.model_outputs), t.form_fields)


@query
def preset_coverage(t: Tables) -> DataFrame:
    return resumes.preset_coverage(t.resumes)


# --- ranking, quotas, codes --------------------------------------------------

@query
def resume_page(t: Tables) -> DataFrame:
    return resumes.resume_page(t.resumes, skip=1, limit=3, newest_by="updated_seq")


@query
def first_available_grant(t: Tables) -> DataFrame:
    return quota.first_available_grant(t.user_activations)


@query
def redeem_codes(t: Tables) -> DataFrame:
    return codes.redeem_codes(t.redeem_requests, t.activation_codes, t.user_activations).verdicts


@query
def redeem_codes_grants(t: Tables) -> DataFrame:
    return codes.redeem_codes(t.redeem_requests, t.activation_codes, t.user_activations).grants


@query
def redeem_codes_state(t: Tables) -> DataFrame:
    state = codes.redeem_codes(t.redeem_requests, t.activation_codes, t.user_activations).codes
    return state.select("code_id", "used_count", "status")


@query
def quota_ledger(t: Tables) -> DataFrame:
    return quota.quota_ledger(t.user_activations, t.quota_uses)


@query
def quota_attribution(t: Tables) -> DataFrame:
    return quota.quota_attribution(t.user_activations, t.quota_uses).uses


@query
def quota_grants_left(t: Tables) -> DataFrame:
    return quota.quota_attribution(t.user_activations, t.quota_uses).grants.select(
        "activation_id", "user_id", "remaining_uses")


@query
def generate_codes(t: Tables) -> DataFrame:
    return codes.generate_codes(t.code_batches, t.activation_codes, F.expr(CODES_AS_OF), CODE_SEED)


# --- documents ---------------------------------------------------------------

@query
def field_count(t: Tables) -> DataFrame:
    return t.resumes.select("resume_id", docs.field_count(F.col("fields")).alias("field_count"))


@query
def resume_text(t: Tables) -> DataFrame:
    return t.resumes.select("resume_id", docs.resume_text(F.col("fields")).alias("resume_text"))


@query
def fields_by_category(t: Tables) -> DataFrame:
    members = F.col("members")
    return resumes.fields_by_category(t.resumes).select(
        "resume_id", "group", F.size(members).alias("n_members"),
        docs.resume_text(members).alias("member_text"))


@query
def merge_fields(t: Tables) -> DataFrame:
    return _edited_entries(t, patch=docs.parse_document(F.col("patch")), field_key=F.lit(None).cast("string"))


@query
def delete_field(t: Tables) -> DataFrame:
    return _edited_entries(t, patch=F.lit(None).cast(docs.DOCUMENT), field_key=F.col("field_key"))


def _edited_entries(t: Tables, **columns: F.Column) -> DataFrame:
    state = resumes.edit_fields(t.resumes, t.field_edits.withColumns(columns)).resumes
    return resumes.entries(state)


def _edits_in_turn(t: Tables) -> DataFrame:
    """Every third request deletes a key, the others merge."""
    deletes = F.col("request_id") % 3 == 1
    return t.field_edits.withColumns({
        "patch": F.when(~deletes, docs.parse_document(F.col("patch"))), "field_key": F.when(deletes, F.col("field_key"))})


def _mixed_edits(t: Tables) -> resumes.Changes:
    """Stamps start empty."""
    return resumes.edit_fields(t.resumes.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), _edits_in_turn(t))


@query
def edit_fields_mixed(t: Tables) -> DataFrame:
    """The documents after merges and deletes in turn, as text, with the time of the last change."""
    return _mixed_edits(t).resumes.select(
        "resume_id", docs.resume_text(F.col("fields")).alias("resume_text"), "updated_at")


@query
def edit_fields_mixed_verdicts(t: Tables) -> DataFrame:
    return _mixed_edits(t).verdicts.select("request_id", "verdict")


@query
def edit_stored_resumes(t: Tables) -> DataFrame:
    """Stored documents after the same edits: sound ones as text, broken ones as they are."""
    state = resumes.edit_stored(t.stored_resumes, _edits_in_turn(t)).resumes
    broken = docs.is_broken(F.col("fields"))
    content = F.when(broken, F.col("fields")).otherwise(docs.resume_text(docs.parse_document(F.col("fields"))))
    return state.select("resume_id", broken.alias("broken"), content.alias("content"))


@query
def edit_stored_verdicts(t: Tables) -> DataFrame:
    return resumes.edit_stored(t.stored_resumes, _edits_in_turn(t)).verdicts.select("request_id", "verdict")


@query
def check_documents(t: Tables) -> DataFrame:
    return integrity.check_rule("resumes", t.stored_resumes, "json_object")


@query
def merge_fields_verdicts(t: Tables) -> DataFrame:
    edits = t.field_edits.withColumns({
        "patch": docs.parse_document(F.col("patch")), "field_key": F.lit(None).cast("string")})
    return resumes.edit_fields(t.resumes, edits).verdicts.select("request_id", "verdict")


@query
def field_descriptors(t: Tables) -> DataFrame:
    return matching.describe_fields(t.form_fields)


# --- prompts and answers -----------------------------------------------------

@query
def build_prompts(t: Tables) -> DataFrame:
    fields = t.form_fields
    checked = forms.checked_requests(t.match_requests, fields, t.resumes, t.users)
    return forms.build_prompts(checked, fields)


@query
def extract_json_array(t: Tables) -> DataFrame:
    return matching.read_answers(t.model_outputs).select("request_id", "answer_verdict")


@query
def normalise_matches(t: Tables) -> DataFrame:
    return matching.match_rows(matching.read_answers(t.model_outputs))


# --- changes behind the active-user gate, with the batch's own deactivations ---

def _gate(t: Tables, requests: DataFrame) -> gate.Gate:
    return gate.behind_gate(requests, t.users, t.deactivations)


@query
def gate_as_of(t: Tables) -> DataFrame:
    return gate.gate_as_of(t.redeem_requests, t.users, t.deactivations)


@query
def gated_redeem(t: Tables) -> DataFrame:
    split = _gate(t, t.redeem_requests)
    return split.verdicts(codes.redeem_codes(split.passed, t.activation_codes, t.user_activations).verdicts)


@query
def gated_redeem_state(t: Tables) -> DataFrame:
    passed = _gate(t, t.redeem_requests).passed
    return codes.redeem_codes(passed, t.activation_codes, t.user_activations).codes.select(
        "code_id", "used_count", "status")


@query
def gated_update_users(t: Tables) -> DataFrame:
    changes = accounts.update_users(derived.view(t.spark, t.sf_dir, "users"), _gate(t, t.user_patches).passed)
    return changes.users.select("user_id", "email", "password_hash", "updated_at")


@query
def gated_update_users_requests(t: Tables) -> DataFrame:
    split = _gate(t, t.user_patches)
    changes = accounts.update_users(derived.view(t.spark, t.sf_dir, "users"), split.passed)
    return split.verdicts(changes.verdicts.select("request_id", "user_id", "verdict"))


@query
def gated_delete_resumes(t: Tables) -> DataFrame:
    return resumes.delete_resumes(t.resumes, _gate(t, t.resume_requests).passed).resumes.select("resume_id", "user_id")


@query
def gated_delete_resumes_verdicts(t: Tables) -> DataFrame:
    split = _gate(t, t.resume_requests)
    return split.verdicts(resumes.delete_resumes(t.resumes, split.passed).verdicts.select("request_id", "verdict"))


def _match_forms(t: Tables) -> forms.FormMatching:
    return forms.match_forms(
        t.match_requests, t.form_fields, t.resumes, t.users, t.user_activations, t.match_answers)


@query
def match_forms(t: Tables) -> DataFrame:
    return _match_forms(t).outcomes


@query
def match_forms_matches(t: Tables) -> DataFrame:
    return _match_forms(t).matches


# --- state transitions -------------------------------------------------------

@query
def register_users(t: Tables) -> DataFrame:
    return accounts.register_users(t.users, t.registrations).verdicts


@query
def register_users_rows(t: Tables) -> DataFrame:
    return accounts.register_users(t.users, t.registrations).users


def _update_users(t: Tables) -> accounts.AccountChanges:
    return accounts.update_users(derived.view(t.spark, t.sf_dir, "users"), t.user_patches)


@query
def update_users(t: Tables) -> DataFrame:
    return _update_users(t).users.select("user_id", "email", "password_hash", "updated_at")


@query
def update_users_verdicts(t: Tables) -> DataFrame:
    """Per user: whether any request was refused."""
    worst = F.when(F.bool_or(F.col("verdict") == "not_found"), "not_found").when(
        F.bool_or(F.col("verdict") == "email_conflict"), "email_conflict").otherwise("ok")
    return _update_users(t).verdicts.groupBy("user_id").agg(worst.alias("verdict"))


@query
def update_users_requests(t: Tables) -> DataFrame:
    return _update_users(t).verdicts.select("request_id", "user_id", "verdict")


@query
def deactivate_users(t: Tables) -> DataFrame:
    return accounts.deactivate_users(t.users, t.deactivations).users.select("user_id", "status")


@query
def deactivate_users_verdicts(t: Tables) -> DataFrame:
    return accounts.deactivate_users(t.users, t.deactivations).verdicts


@query
def touch_updated_at(t: Tables) -> DataFrame:
    return accounts.deactivate_users(t.users, t.deactivations).users.select(
        "user_id", "created_at", "updated_at")


@query
def create_resumes(t: Tables) -> DataFrame:
    state = t.resumes.drop("updated_seq").withColumns({
        "created_at": F.lit(None).cast("timestamp_ntz"), "updated_at": F.lit(None).cast("timestamp_ntz")})
    fresh = t.resume_requests.withColumns({
        "resume_id": F.col("request_id") + 1_000_000_000, "fields": docs.parse_document(F.col("fields"))})
    return resumes.create_resumes(state, fresh).select(
        "resume_id", "user_id", "title", docs.resume_text(F.col("fields")).alias("resume_text"), "updated_at")


def _update_resumes(t: Tables) -> resumes.Changes:
    requests = t.resume_requests.withColumn("fields", docs.parse_document(F.col("fields")))
    return resumes.update_resumes(t.resumes, requests)


@query
def update_resumes(t: Tables) -> DataFrame:
    return _update_resumes(t).resumes.select(
        "resume_id", "user_id", "title", docs.resume_text(F.col("fields")).alias("resume_text"))


@query
def update_resumes_verdicts(t: Tables) -> DataFrame:
    return _update_resumes(t).verdicts.select("request_id", "verdict")


@query
def delete_resumes(t: Tables) -> DataFrame:
    return resumes.delete_resumes(t.resumes, t.resume_requests).resumes.select("resume_id", "user_id")


@query
def delete_resumes_verdicts(t: Tables) -> DataFrame:
    return resumes.delete_resumes(t.resumes, t.resume_requests).verdicts.select("request_id", "verdict")


@query
def migrate_resumes(t: Tables) -> DataFrame:
    plain = resumes.migrate_resumes(t.legacy_resumes)
    filled = resumes.migrate_resumes(t.legacy_resumes, backfill=True)
    return reduce(DataFrame.unionByName, [
        df.select(F.lit(mode).alias("mode"), "resume_id", "user_id", "title",
                  docs.resume_text(F.col("fields")).alias("resume_text"))
        for mode, df in (("plain", plain), ("backfill", filled))])


@query
def migrate_timestamps(t: Tables) -> DataFrame:
    zoned = t.usage_logs.withColumn("used_at", F.col("used_at").cast("timestamp"))
    return accounts.migrate_timestamps(zoned, "used_at").select("log_id", "used_at")


# --- streams -----------------------------------------------------------------

def _stream(t: Tables, name: str) -> DataFrame:
    return derived.stream_view(t.spark, t.sf_dir, name)


@query
def stream_match_stats(t: Tables) -> DataFrame:
    return usage.stream_match_stats(_stream(t, "usage_logs"), work_dir(t.spark, "stream"))


@query
def stream_daily_usage(t: Tables) -> DataFrame:
    return usage.stream_daily_usage(_stream(t, "usage_logs"), work_dir(t.spark, "stream"))


@query
def stream_extract_matches(t: Tables) -> DataFrame:
    return usage.stream_extract_matches(_stream(t, "model_outputs"), work_dir(t.spark, "stream"))


def _replay(t: Tables, rows: DataFrame, slices: tuple, advance: Callable[[DataFrame, str, bool], DataFrame]) -> DataFrame:
    """Let rows arrive in slices, running the stream after each; the last one ends it."""
    folder = work_dir(t.spark, "stream")
    landing, result = f"{folder}/landing", None
    for arrived in slices:
        tables.append_table(rows.filter(arrived), landing)
        result = advance(tables.stream_table(t.spark, landing, rows.schema), folder, arrived is slices[-1])
    return result


def _by_time(at: str) -> tuple:
    return F.col(at) < F.expr(ARRIVAL_CUT), F.col(at) >= F.expr(ARRIVAL_CUT)


def _ledger(t: Tables, slices: tuple, delay: timedelta) -> DataFrame:
    # numbering the uses takes a sort of all lines: done once for all slices
    folder = work_dir(t.spark, "events")
    tables.write_version(quota.quota_events(t.user_activations, t.quota_uses), folder)
    events = tables.read_table(t.spark, folder)
    return _replay(t, events, slices,
                   lambda stream, folder, last: stateful.stream_quota_ledger(stream, folder, delay, last))


def _redeem(t: Tables, slices: tuple, delay: timedelta) -> DataFrame:
    state, grants = t.activation_codes, t.user_activations
    return _replay(t, t.redeem_requests, slices,
                   lambda stream, folder, last: stateful.stream_redeem(stream, state, grants, folder, delay, last))


@query
def stream_quota_ledger(t: Tables) -> DataFrame:
    return _ledger(t, _by_time("event_at"), stateful.AT_ONCE).drop("late")


@query
def stream_quota_ledger_shuffled(t: Tables) -> DataFrame:
    """Events arrive in no order of time, but within the delay."""
    odd = F.col("event_id") % 2 == 1
    return _ledger(t, (odd, ~odd), ANY_TIME)


@query
def stream_redeem(t: Tables) -> DataFrame:
    return _redeem(t, _by_time("requested_at"), stateful.AT_ONCE)


@query
def stream_redeem_late(t: Tables) -> DataFrame:
    """A tenth of the requests arrives after time has passed most of them."""
    behind = F.col("request_id") % 10 == 7
    return _redeem(t, (~behind & (F.col("requested_at") < F.expr(ARRIVAL_CUT)), behind | (F.col("requested_at") >= F.expr(ARRIVAL_CUT))),
                   stateful.AT_ONCE)
