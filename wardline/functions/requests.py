"""Per-request features, attack classes and decision rules as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.patterns import FAMILIES, PAYLOAD_VARIANTS, SENSITIVE_ENDPOINTS, SIGNATURES
from wardline.functions.scalars import case_map, contains_any, first_filled, flag, pattern_count, when_chain


def request_features(logs: DataFrame, keep: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """42 features of every request, in three projections: texts, joined and lower-cased texts, features.

    ``logs``: method, request_body, request_url, response_body, status, response_time, user_identity; blanks and nulls
    count as empty, an unreadable response time as 0.
    """
    text = {c: first_filled(c) for c in ("method", "request_body", "request_url", "response_body", "status", "response_time", "user_identity")}
    base = logs.select(*keep, *(v.alias(f"_{k}") for k, v in text.items()))
    searched = {
        "_both": F.concat_ws(" ", "_request_url", "_request_body"), "_all3": F.concat_ws(" ", "_request_body", "_request_url", "_response_body"),
        "_json": F.concat("_request_body", "_response_body"),
    }
    # each text is joined and lower-cased once, not once a pattern
    base = base.withColumns(searched).withColumns({f"{c}_low": F.lower(c) for c in (*searched, "_request_url", "_request_body", "_response_body")})
    m, body, url, answer, status, who = (F.col(f"_{c}") for c in ("method", "request_body", "request_url", "response_body", "status", "user_identity"))
    rt = F.coalesce(F.expr("try_cast(_response_time as double)"), F.lit(0.0))
    low = F.lower(who)
    guest = F.when(low.isin("user", "guest"), 2 * flag(contains_any(F.lower(url), ["/admin", "/delete", "/drop", "/truncate"])) + flag(F.upper(m).isin("DELETE", "PUT", "PATCH"))).otherwise(0)
    answer_size = F.length(answer)

    def count(column: str, family: str) -> Column:
        return pattern_count(column, FAMILIES[family], f"{column}_low")

    scores = {
        "dir_traversal_score": count("_all3", "dir_traversal"),
        "xss_score": count("_all3", "xss"),
        "injection_score": count("_all3", "injection"),
        "sensitive_data_leakage": count("_response_body", "sensitive_data"),
        "sensitive_in_request": count("_request_body", "sensitive_data"),
        "invalid_value_score": count("_both", "invalid_value"),
        "unauthorized_access_score": guest + count("_request_url", "unauthorized"),
        "performance_issue_score": count("_all3", "performance") + flag(answer_size > 10000) + 2 * flag(answer_size > 50000),
        "json_anomaly_score": count("_json", "json_anomaly"),
    }
    one = base.select(
        *keep,
        *(flag(F.upper(m) == x).alias(f"method_{x.lower()}") for x in ("GET", "POST", "PUT", "DELETE", "PATCH")),
        *(flag(status.startswith(x)).alias(f"status_{x}xx") for x in "245"),
        flag(status.isin("400", "401", "403", "404")).alias("status_client_error"),
        rt.alias("response_time_ms"), flag(rt > 1000).alias("slow_response"), flag(rt > 3000).alias("very_slow_response"),
        F.length(body).alias("request_body_length"), F.length(url).alias("request_url_length"), answer_size.alias("response_body_length"),
        (F.length(body) + F.length(url) + answer_size).alias("total_payload_length"),
        *(v.alias(k) for k, v in scores.items()),
        F.regexp_count(url, F.lit("/")).alias("url_depth"), flag(F.contains(url, F.lit("?"))).alias("has_query_params"),
        (F.regexp_count(url, F.lit("&")) + flag(F.contains(url, F.lit("?")))).alias("query_param_count"),
        flag(contains_any(url, SENSITIVE_ENDPOINTS)).alias("is_sensitive_endpoint"),
        flag(F.contains(low, F.lit("admin"))).alias("is_admin"), flag(F.contains(low, F.lit("root"))).alias("is_root"),
    )
    privileged = F.greatest("is_admin", "is_root")
    named = [k for k in scores if k != "sensitive_in_request"]
    return one.select(
        "*", privileged.alias("is_privileged_user"),
        flag((privileged == 0) & (F.col("is_sensitive_endpoint") == 1) & (F.col("slow_response") == 1)).alias("high_risk_combo"),
        flag((F.col("injection_score") > 0) & (F.col("status_2xx") == 1)).alias("injection_with_success"),
        *(flag(F.col(k) > 0).alias("has_" + k.replace("_score", "")) for k in named),
    )


def regex_class(text: Column) -> Column:
    """(type, confidence) of the signature with the highest confidence; the first type wins ties; none: unknown, 0."""
    best = {t: F.greatest(*(F.when(F.rlike(text, F.lit(f"(?i){p}")), F.lit(c)).otherwise(F.lit(0.0)) for p, c in ps)) for t, ps in SIGNATURES.items()}
    ranked = [F.struct(c.alias("confidence"), F.lit(-i).alias("order"), F.lit(t).alias("type")) for i, (t, c) in enumerate(best.items())]
    top = F.greatest(*ranked, F.struct(F.lit(0.0).alias("confidence"), F.lit(1).alias("order"), F.lit("unknown").alias("type")))
    return F.struct(top["type"].alias("type"), top["confidence"].alias("confidence"))


def source_category() -> Column:
    """Category of a unified record: rules, alerts, latency and status in this order."""
    bad = (
        ((F.col("rule_id") != "") & F.col("severity").isin("CRITICAL", "HIGH"))
        | F.col("alert_type").isin("injection", "xss", "directory_traversal", "sensitive_data")
        | (F.col("latency_ms") > 100)
        | (F.col("status").isin(403, 500) & F.col("severity").isin("HIGH", "MEDIUM"))
    )
    return F.when(bad, "malicious_crawler").otherwise("normal")


def heuristic_anomaly() -> Column:
    """Cheap anomaly test of a request: (method, path, status, response_time)."""
    path = F.lower("path")
    return F.coalesce(
        (F.col("status") >= 500)
        | (F.col("response_time") > 2000)
        | ((F.col("status") == 403) & F.contains(path, F.lit("/admin")))
        | (F.col("method").isin("OPTIONS", "TRACE") & F.contains(path, F.lit("/api")))
        | contains_any(path, ["../", "'", "<script"]),
        F.lit(False),
    )


def hard_override(predicted: Column) -> Column:
    """Force the anomaly label on very slow or traversing requests."""
    return F.when((F.col("response_time") > 2000) | F.contains("path", F.lit("../")), 1).otherwise(predicted)


def category_type(category: Column | str = "category") -> Column:
    from wardline.functions.patterns import CATEGORY_TYPES

    return case_map(category, CATEGORY_TYPES)


def payload_variant(text: Column) -> Column:
    """First variant whose keywords stand in the text."""
    low = F.lower(text)
    return when_chain((contains_any(low, words), F.lit(v)) for v, words in PAYLOAD_VARIANTS).otherwise(F.lit("default"))


# ---- decision rules


def slow_for_class() -> Column:
    """Response-time limits in ms by kind of endpoint: admin 3000, complex 4000, searches 3000, else 2000; 5000 at most."""
    p = F.lower("path")
    limit = (
        F.when(F.contains(p, F.lit("/admin")), 3000)
        .when(contains_any(p, ["report", "export", "sync", "bulk"]), 4000)
        .when((F.col("method") == "GET") & (F.contains(p, F.lit("?")) | contains_any(p, ["search", "batch"])), 3000)
        .otherwise(2000)
    )
    return F.coalesce((F.col("response_time") > limit) | (F.col("response_time") > 5000), F.lit(False))


def access_decision() -> Column:
    """Unauthorised access: admins pass; system paths, other admins' data, and batch reads of restricted paths without a user id don't."""
    path = F.regexp_extract("path", r"^[^?]*", 0)
    query = F.regexp_extract("path", r"\?(.*)$", 1)
    restricted = F.rlike(path, F.lit(r"^(/api)?/(addresses|afterSaleServices)(/|$)"))
    return (
        F.when(F.lower("user_identity") == "admin", F.lit(False))
        .when(F.contains("path", F.lit("..")), F.lit(False))
        .when(F.rlike(path, F.lit(r"/(sysManager|server)/|/adminInfo|/adminDashboard")), F.lit(True))
        .when(F.rlike(path, F.lit(r"/admins/")) & ~F.rlike(path, F.lit(r"/admins/self$")), F.lit(True))
        .when(restricted & F.rlike(query, F.lit(r"(^|&)(userId|customerId|user_id)=")), F.lit(False))
        .when(restricted & F.rlike(query, F.lit(r"(^|&)(page|limit|all|scope|admin_view)=")), F.lit(True))
        .otherwise(F.lit(False))
    )


def traversal_decision() -> Column:
    """Path traversal after two rounds of percent-decoding: two steps up, an encoded step, or a step with a system file."""
    once = F.coalesce(F.try_url_decode("path"), F.col("path"))
    twice = F.coalesce(F.try_url_decode(once), once)
    files = F.rlike(twice, F.lit(r"/etc/(passwd|shadow|hosts)|/proc/|boot\.ini"))
    encoded = F.rlike("path", F.lit(r"(?i)(\.|%2e|%252e){2}(%2f|%5c|%252f)|%2e%2e/"))
    return (F.regexp_count(twice, F.lit(r"\.\./")) >= 2) | encoded | files


def leak_confidence(text: Column | str) -> Column:
    """Confidence that a response leaks: secrets .95, identity numbers and cards .85, mail addresses .70; masked values 0."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (
        F.when(F.rlike(t, F.lit(r"(?i)(password|secret|api[_-]?key|token)\s*[:=]\s*.?[*xX]{4,}")), 0.0)
        .when(F.rlike(t, F.lit(r"(?i)(password|secret|api[_-]?key|private[_-]?key|token)\W{0,3}[:=]\s*['\"]?[^\s'\"*]{6,}")), 0.95)
        .when(F.rlike(t, F.lit(r"\b[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")), 0.85)
        .when(F.rlike(t, F.lit(r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}")), 0.70)
        .otherwise(0.0)
    )


def _route(path: str) -> Column:
    return F.regexp_extract(F.lower(path), r"^[^?]*", 0)


def auth_flow(path: str = "path") -> Column:
    """Whether a path belongs to logging in, registering, or changing a password."""
    return F.rlike(_route(path), F.lit(r"/(login|logout|register|signup|auth|oauth|token|password)(/|$)"))


def leak_in_context(text: str = "response_body", path: str = "path", method: str = "method", identity: str = "user_identity") -> Column:
    """``leak_confidence`` by what the request is for.

    What users send and get back when they log in or register is no leak; nor are mail addresses and numbers where users read their own
    profile, or admins the data they manage. Secrets count everywhere else.
    """
    c = leak_confidence(text)
    own = F.rlike(_route(path), F.lit(r"/(profile|me|self)(/|$)"))
    managed = (F.lower(identity) == "admin") & F.rlike(_route(path), F.lit(r"^(/api)?/(admin|metadata)(/|$)"))
    return F.when(auth_flow(path) & (F.upper(method) == "POST"), 0.0).when((own | managed) & (c < 0.95), 0.0).otherwise(c)


def injection_in_context(text: str, path: str = "path") -> Column:
    """``injection_decision`` by kind of endpoint.

    Stricter where users authenticate: a quote that a comment closes is enough. More lenient where users search or comment: a
    statement counts only with a quote, a bracket, a semicolon or a comment to break out of its field.
    """
    plain, t = injection_decision(text), F.coalesce(F.col(text), F.lit(""))
    free = F.rlike(_route(path), F.lit(r"/(search|find|comments?|reviews?|feedback)(/|$)"))
    return F.when(auth_flow(path), plain | F.rlike(t, F.lit(r"'\s*(--|#|/\*)"))).when(free, plain & F.rlike(t, F.lit(r"['\");]|--"))).otherwise(plain)


def injection_decision(text: Column | str) -> Column:
    """A whole hostile statement or a tautology; lone quotes, semicolons and keywords are normal."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.rlike(t, F.lit(r"(?i)union\s+(all\s+)?select|drop\s+table|insert\s+into\s+\w+|delete\s+from\s+\w+|;\s*(cat|curl|wget|rm)\s|'\s*(or|and)\s+('?\w+'?)\s*=\s*'?\w+|sleep\(\s*[0-9]+\s*\)"))


def script_decision(text: Column | str) -> Column:
    """Script tags, event handlers, script protocols, plain or percent-encoded."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    t = F.coalesce(F.try_url_decode(t), t)
    return F.rlike(t, F.lit(r"(?i)<script|<iframe|<svg[^>]*on\w+\s*=|\son(error|load|click|mouseover)\s*=|javascript:"))


def invalid_value_decision(name: Column | str, value: Column | str) -> Column:
    """Values that can't be: mojibake, words in number fields, impossible dates and prices; free text is exempt."""
    n, v = (F.lower(F.col(name)), F.col(value)) if isinstance(name, str) else (F.lower(name), value)
    number = n.isin("age", "quantity", "qty", "price", "amount", "id", "score")
    return (
        F.when(n.isin("address", "description", "comment", "email", "phone"), F.lit(False))
        .when(F.rlike(v, F.lit("�|Ã.|â€")), F.lit(True))
        .when(number & F.expr(f"try_cast({value if isinstance(value, str) else 'value'} as double)").isNull(), F.lit(True))
        .when(n.isin("price", "amount", "qty", "quantity", "age") & (F.try_to_number(v, F.lit("S999999999999")) < 0), F.lit(True))
        .when(F.contains(n, F.lit("date")) & (F.coalesce(F.expr(f"try_cast(substr({value if isinstance(value, str) else 'value'}, 1, 4) as int)"), F.lit(0)) > 2100), F.lit(True))
        .otherwise(F.lit(False))
    )
