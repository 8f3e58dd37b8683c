"""Form matching end to end as one plan over request, resume, grant and answer tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.documents import resume_text
from fieldloom.functions.numbers import ratio
from fieldloom.operators import lookup, matching, quota
from fieldloom.operators.skew import first_rows, hot_keys, shared
from fieldloom.sources.tables import usage_log_rows


class FormMatching:
    """Requests with their outcome and matches, and the outputs that follow from them."""

    def __init__(self, judged: DataFrame, requests: DataFrame, grants: DataFrame):
        self._judged, self._requests, self._grants = judged, requests, grants
        self._succeeded = F.col("outcome") == "ok"

    @cached_property
    def _counted(self) -> DataFrame:
        def counted(count: Column) -> Column:
            return F.when(self._succeeded, count).otherwise(0)

        return self._judged.select(
            "request_id", "user_id", "website_url", "requested_at", "outcome",
            F.col("n_fields").alias("total_fields"),
            counted(matching.success_count(F.col("matches"))).alias("success_count"),
            counted(matching.matched_fields(F.col("matches"))).alias("matched_fields"))

    @cached_property
    def _charged(self) -> DataFrame:
        """The requests run through the quota timeline themselves, failed ones with a
        charge of 0, so no charge has to be joined back."""
        events = quota.grant_events(self._grants).unionByName(self._counted.withColumns({
            "event_at": F.col("requested_at"), "kind": F.lit(quota.USE), "event_id": F.col("request_id"),
            "delta": F.when(self._succeeded, -1).otherwise(0).cast("long"),
        }), allowMissingColumns=True)
        # the lookups keep every request, so its users can be counted before them
        users = self._grants.select("user_id").unionByName(self._requests.select("user_id"))
        timeline = quota.ledger_timeline(events, hot_keys(users, ["user_id"]))
        return timeline.rows().filter(F.col("kind") == quota.USE)

    @property
    def outcomes(self) -> DataFrame:
        """Every request: outcome, counts, rate, and whether a use was charged."""
        return self._charged.select(
            "request_id", "user_id", "outcome", "total_fields", "matched_fields", "success_count",
            ratio(F.col("matched_fields"), F.col("total_fields")).alias("match_rate"),
            (self._succeeded & F.col("ok")).alias("charged"))

    @property
    def ledger(self) -> DataFrame:
        """The quota verdict of each charge."""
        return self._charged.filter(self._succeeded).select(
            F.col("request_id").alias("use_id"), "user_id", F.col("requested_at").alias("used_at"), "ok", "balance")

    @property
    def matches(self) -> DataFrame:
        """Valid matches of successful requests, long form."""
        return matching.match_rows(self._judged.filter(self._succeeded))

    @property
    def logs(self) -> DataFrame:
        """Usage log rows to append."""
        return usage_log_rows(self._counted.filter(self._succeeded))


def checked_requests(requests: DataFrame, form_fields: DataFrame, resumes: DataFrame,
                     users: DataFrame) -> DataFrame:
    """Requests with the first failure before the model is asked, or ``ok``."""
    gated = lookup.active_user_gate(requests, users)
    with_resume = lookup.requests_with_resume(gated, resumes, resume_text(F.col("fields")))
    checked = matching.with_form_verdict(with_resume, form_fields)
    verdict = (F.when(F.col("gate") != "pass", F.col("gate"))
               .when(F.col("form_verdict") != "ok", F.col("form_verdict"))
               .otherwise(F.col("resume_verdict")))
    return checked.withColumn("check_verdict", verdict)


def build_prompts(checked: DataFrame, form_fields: DataFrame) -> DataFrame:
    """The prompt of every request that passed its checks."""
    passed = checked.filter(F.col("check_verdict") == "ok").select("request_id", "resume_text")
    return passed.join(matching.field_lines(form_fields), "request_id").select(
        "request_id", matching.prompt_text(F.col("resume_text"), F.col("fields_text")).alias("prompt"))


def judged_requests(checked: DataFrame, answers: DataFrame) -> DataFrame:
    """Checked requests with their outcome and matches.

    Answers are parsed after the join, and only those of requests that passed.
    """
    passed = F.col("check_verdict") == "ok"
    # one answer per request: repeated ones must not be logged and charged again
    single = first_rows(answers.select("request_id", "status_code", "output_text"), ["request_id"],
                        ["status_code", "output_text"])
    joined = checked.join(single, "request_id", "left")
    read = matching.with_answer(joined.withColumn("status_code", F.when(passed, F.col("status_code"))))
    return read.withColumn(
        "outcome", F.when(passed, F.col("answer_verdict")).otherwise(F.col("check_verdict")))


def match_forms(requests: DataFrame, form_fields: DataFrame, resumes: DataFrame, users: DataFrame,
                grants: DataFrame, answers: DataFrame) -> FormMatching:
    """Outcome of every request, given the model's answers.

    A request that fails before the log writes no log and is charged nothing.
    A charge that finds no use left does not undo the match.
    """
    checked = checked_requests(requests, form_fields, resumes, users)
    return FormMatching(shared(judged_requests(checked, answers).drop("resume_text")), requests, grants)
