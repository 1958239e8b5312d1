"""Chat exports of seven platforms as one shape (SRC-01..08), and agent logs (SRC-09).

Payloads are parsed once as variants, so fields of varying type are told apart by what they hold. Everything is a column
expression: one export is one row in and one row per conversation out, and no row needs another.

Output of normalize(): the input's other columns, position, external_id, title, model, started_at, ended_at, messages
(array of external_id, parent_external_id, role, author, model, content, created_at) and error. A payload that is not
what its platform exports gives one row with only the error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as X

MESSAGE = "struct<external_id:string,parent_external_id:string,role:string,author:string,model:string,content:string,created_at:timestamp>"
CONVERSATION = f"struct<external_id:string,title:string,model:string,started_at:timestamp,ended_at:timestamp,messages:array<{MESSAGE}>>"
PROMPT, TITLE_BYTES = "Prompted ", 120


class UnsupportedPlatformError(ValueError):
    """No adapter has that name."""


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def string(v: Column, path: str) -> Column:
    """The string there; null if it is anything else."""
    return F.when(F.schema_of_variant(at(v, path)) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def number(v: Column, path: str) -> Column:
    kind = F.schema_of_variant(at(v, path))
    return F.when((kind == "BIGINT") | (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, f"$.{path}", "double"))


def items(v: Column, path: str = "") -> Column:
    """The array there, as variants; null if there is none."""
    return F.try_variant_get(v, f"$.{path}" if path else "$", "array<variant>")


def strings(vs: Column) -> Column:
    return F.transform(F.filter(vs, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))


def first_string(v: Column, *paths: str) -> Column:
    """The string under the first of the keys that is there at all."""
    out = none()
    for p in reversed(paths):
        out = F.when(at(v, p).isNotNull(), string(v, p)).otherwise(out)
    return out


def message(role: Column, content: Column, time: Column, external_id=None, parent=None, author=None, model=None) -> Column:
    pick = lambda x: none() if x is None else x
    return F.struct(pick(external_id).alias("external_id"), pick(parent).alias("parent_external_id"), role.alias("role"), pick(author).alias("author"), pick(model).alias("model"), content.alias("content"), time.alias("created_at"))


def spoken(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["content"].isNotNull())


def conversation(external_id: Column, title: Column, model: Column, started: Column, ended: Column, messages: Column) -> Column:
    return F.struct(external_id.alias("external_id"), title.alias("title"), model.alias("model"), started.alias("started_at"), ended.alias("ended_at"), messages.alias("messages")).cast(CONVERSATION)


def chatgpt(v: Column) -> tuple[Column, Column]:
    """SRC-02: the active branch only, from current_node up through parents; regenerated siblings are not on it."""

    def one(c: Column) -> Column:
        nodes = F.try_variant_get(c, "$.mapping", "map<string,variant>")
        none_yet = F.struct(F.array().cast("array<string>").alias("chain"), string(c, "current_node").alias("node"))
        step = lambda a, _: F.when(a["node"].isNull(), a).otherwise(F.struct(F.concat(a["chain"], F.array(a["node"])).alias("chain"), string(F.try_element_at(nodes, a["node"]), "parent").alias("node")))
        walk = F.aggregate(F.sequence(F.lit(0), F.size(nodes)), none_yet, step)

        def said(k: Column) -> Column:
            n = F.element_at(nodes, k)
            text = X.non_blank(F.array_join(strings(items(n, "message.content.parts")), "\n"))
            role = X.normalize_role(F.coalesce(string(n, "message.author.role"), F.lit("other")))
            return message(role, text, X.from_epoch_seconds(number(n, "message.create_time")), string(n, "message.id"), string(n, "parent"), string(n, "message.author.name"), string(n, "message.metadata.model_slug"))

        told = spoken(F.transform(F.reverse(walk["chain"]), said))
        out = conversation(first_string(c, "conversation_id", "id"), string(c, "title"), string(c, "default_model_slug"), X.from_epoch_seconds(number(c, "create_time")), X.from_epoch_seconds(number(c, "update_time")), told)
        error = F.when(nodes.isNull(), "conversation missing 'mapping' object").when(walk["node"].isNotNull(), "cycle in mapping parent chain")
        return F.struct(out.alias("c"), error.alias("error"))

    made = F.transform(items(v), one)
    return F.transform(made, lambda x: x["c"]), F.coalesce(F.when(made.isNull(), "top level must be an array"), F.get(F.filter(F.transform(made, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0)))


def _each(conversations: Column, inner: str, one: Callable[[Column, Column], Column], missing: str) -> tuple[Column, Column]:
    bad = F.exists(conversations, lambda c: items(c, inner).isNull())
    return F.transform(conversations, one), F.when(conversations.isNull(), missing).when(bad, f"conversation missing '{inner}' array")


def claude(v: Column) -> tuple[Column, Column]:
    """SRC-03."""

    def said(m: Column) -> Column:
        blocks = F.filter(items(m, "content"), lambda b: string(b, "type") == "text")
        joined = X.non_blank(F.array_join(F.filter(F.transform(blocks, lambda b: string(b, "text")), lambda t: t.isNotNull()), "\n"))
        text = F.coalesce(joined, X.non_blank(string(m, "text")))
        return message(X.normalize_role(F.coalesce(string(m, "sender"), F.lit("other"))), text, X.rfc3339(string(m, "created_at")), string(m, "uuid"))

    one = lambda c, _i: conversation(string(c, "uuid"), string(c, "name"), string(c, "model"), X.rfc3339(string(c, "created_at")), X.rfc3339(string(c, "updated_at")), spoken(F.transform(items(c, "chat_messages"), said)))
    return _each(items(v), "chat_messages", one, "top level must be an array")


def gemini(v: Column) -> tuple[Column, Column]:
    """SRC-04: one record is one conversation; its number is that in the whole export."""

    def one(r: Column, i: Column) -> Column:
        title = string(r, "title")
        prompt = F.when(title.startswith(PROMPT), X.non_blank(F.substring(title, F.lit(len(PROMPT) + 1), F.length(title))))
        time = X.rfc3339(string(r, "time"))
        answer = F.nullif(X.strip_html(string(r, "safeHtmlItem.htmlValue")), F.lit(""))
        told = spoken(F.array(message(F.lit("user"), prompt, time), message(F.lit("assistant"), answer, time)))
        return F.when(prompt.isNotNull(), conversation(F.concat(F.lit("takeout-"), i.cast("string")), X.truncate_bytes(prompt, TITLE_BYTES), none(), time, time, told))

    made = F.filter(F.transform(items(v), one), lambda c: c.isNotNull())
    return made, F.when(made.isNull(), "top level must be an array").when(F.size(made) == 0, "no prompted activity records")


def grok(v: Column) -> tuple[Column, Column]:
    """SRC-05: times are epoch milliseconds, as numbers or as strings."""
    time = lambda x, p: X.from_epoch_millis(F.coalesce(number(x, p), string(x, p).try_cast("double")))
    said = lambda m: message(X.normalize_role(F.coalesce(string(m, "sender"), F.lit("other"))), X.non_blank(string(m, "message")), time(m, "create_time"), string(m, "response_id"), model=string(m, "model"))
    one = lambda c, _i: conversation(first_string(c, "conversation_id", "id"), string(c, "title"), none(), time(c, "create_time"), time(c, "update_time"), spoken(F.transform(items(c, "responses"), said)))
    return _each(F.coalesce(items(v, "conversations"), items(v)), "responses", one, "expected 'conversations' or a top-level array")


def perplexity(v: Column) -> tuple[Column, Column]:
    """SRC-06: each entry is a question and an answer."""

    def one(t: Column, i: Column) -> Column:
        def said(e: Column) -> Column:
            time = X.rfc3339(string(e, "timestamp"))
            return F.array(message(F.lit("user"), X.non_blank(string(e, "query")), time), message(F.lit("assistant"), X.non_blank(string(e, "answer")), time))

        told = spoken(F.flatten(F.transform(items(t, "entries"), said)))
        return conversation(F.coalesce(first_string(t, "id", "uuid"), F.concat(F.lit("thread-"), i.cast("string"))), string(t, "title"), none(), F.get(told, F.lit(0))["created_at"], F.get(told, F.size(told) - 1)["created_at"], told)

    threads = F.coalesce(items(v, "threads"), F.when(items(v, "entries").isNotNull(), F.array(v)))
    return _each(threads, "entries", one, "expected 'threads' or top-level 'entries'")


def copilot(v: Column) -> tuple[Column, Column]:
    """SRC-07, AGG-15: a session is one conversation, from the first to the last known time."""
    author = string(v, "requesterUsername")

    def said(r: Column) -> Column:
        time = X.from_epoch_millis(number(r, "timestamp"))
        values = F.filter(F.transform(items(r, "response"), lambda p: X.non_blank(string(p, "value"))), lambda t: t.isNotNull())
        user = message(F.lit("user"), X.non_blank(string(r, "message.text")), time, string(r, "requestId"), author=author)
        return F.array(user, message(F.lit("assistant"), F.nullif(F.array_join(values, "\n"), F.lit("")), time, author=F.lit("copilot"), model=string(r, "modelId")))

    told = spoken(F.flatten(F.transform(items(v, "requests"), said)))
    times = F.filter(F.transform(told, lambda m: m["created_at"]), lambda t: t.isNotNull())
    one = conversation(string(v, "sessionId"), string(v, "customTitle"), none(), F.get(times, F.lit(0)), F.get(times, F.size(times) - 1), told)
    return F.array(one), F.when(items(v, "requests").isNull(), "expected a 'requests' array")


def generic(v: Column) -> tuple[Column, Column]:
    """SRC-08: the tag of the format is not looked at, and no message has a parent."""
    said = lambda m: message(X.normalize_role(F.coalesce(string(m, "role"), F.lit("other"))), X.non_blank(string(m, "content")), X.rfc3339(string(m, "created_at")), string(m, "id"), author=string(m, "author"), model=string(m, "model"))
    one = lambda c, _i: conversation(string(c, "id"), string(c, "title"), string(c, "model"), X.rfc3339(string(c, "started_at")), X.rfc3339(string(c, "ended_at")), spoken(F.transform(items(c, "messages"), said)))
    return _each(items(v, "conversations"), "messages", one, "missing 'conversations' array")


ADAPTERS = {"chatgpt": chatgpt, "claude": claude, "gemini": gemini, "grok": grok, "perplexity": perplexity, "copilot": copilot, "generic": generic}


def normalize(platform: str, raw: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-01: rows of a platform's exports (JSON text) to rows of conversations."""
    if platform not in ADAPTERS:
        raise UnsupportedPlatformError(platform)
    keep = [c for c in raw.columns if c != payload]
    rows = raw.withColumn("_v", F.try_parse_json(payload))
    made, error = ADAPTERS[platform](F.col("_v"))
    error = F.when(F.col("_v").isNull(), "not JSON").otherwise(error)
    rows = rows.select(*keep, made.cast(f"array<{CONVERSATION}>").alias("_made"), error.alias("error"))
    rows = rows.withColumn("_made", F.when(F.col("error").isNull(), F.col("_made")))
    return rows.select(*keep, "error", F.posexplode_outer("_made").alias("position", "_c")).where("position IS NOT NULL OR error IS NOT NULL").select(*keep, "position", "_c.*", "error")


def log_content(v: Column) -> Column:
    """FN-28: a log line's text: a string, blocks that are strings or have a text, or an object with a text."""
    c = F.coalesce(at(v, "content"), at(v, "text"))
    block = lambda b: F.coalesce(F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")), string(b, "text"))
    joined = F.array_join(F.filter(F.transform(items(c), block), lambda t: t.isNotNull()), "\n")
    kind = F.schema_of_variant(c)
    return X.non_blank(F.when(kind == "STRING", F.try_variant_get(c, "$", "string")).when(kind.startswith("ARRAY"), joined).otherwise(string(c, "text")))


def agent_log(lines: DataFrame) -> DataFrame:
    """SRC-09: (session, title, line, value) rows of JSONL to (session, title, messages, error).

    A session with a line that is no JSON has only the error, with the number of the first such line; blank lines are
    skipped. Times that are not RFC 3339 text are null. Message ids are not kept.
    """
    rows = lines.where(F.trim("value") != "").withColumn("_v", F.try_parse_json("value"))
    v = F.col("_v")
    said = message(X.normalize_role(F.coalesce(first_string(v, "role", "type", "sender"), F.lit("other"))), log_content(v), X.rfc3339(first_string(v, "timestamp", "created_at")))
    bad = F.min(F.when(v.isNull(), F.col("line")))
    told = F.transform(F.array_sort(F.collect_list(F.when(said["content"].isNotNull(), F.struct("line", said.alias("m"))))), lambda x: x["m"])
    out = rows.groupBy("session", "title").agg(told.alias("messages"), bad.alias("_bad"))
    error = F.when(F.col("_bad").isNotNull(), F.concat(F.lit("invalid JSONL at line "), F.col("_bad").cast("string")))
    return out.select("session", "title", F.when(F.col("_bad").isNull(), F.col("messages")).alias("messages"), error.alias("error"))
