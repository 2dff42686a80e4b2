"""Pattern tables and keyword lists of the detection rules."""

# Pattern families of the request features, counted without regard to case.
FAMILIES = {
    "dir_traversal": [
        r"\.\./", r"\.\.\\", r"/etc/passwd", r"/etc/shadow", r"\.\.%2f", r"\.\.%5c", r"/proc/", r"/var/log/", r"\.\.\\\.\.", r"\.\./\.",
    ],
    "xss": [
        r"<script.*?>.*?</script>", r"javascript:", r"alert\(.*?\)", r"onerror\s*=", r"onload\s*=", r"onclick\s*=", r"eval\s*\(",
        r"document\.cookie", r"window\.location", r"<iframe.*?>", r"<img.*?onerror.*?>", r"<svg.*?>.*?</svg>", r"<object.*?>",
    ],
    "injection": [
        r"'.*?(or|and).*?=.*?'", r"union.*?select", r"sleep\(.*?\)", r"benchmark\(.*?\)", r"waitfor.*?delay", r"drop\s+table",
        r"insert\s+into", r"delete\s+from", r"update\s+.*?\s+set", r"\$\{.*?\}", r"\$ne\s*:", r"\$gt\s*:", r"\$where\s*:",
        r"\|\s*[a-z]", r";\s*[a-z]", r"`.*?`", r"\$\(.*?\)",
    ],
    "sensitive_data": [
        r"password\s*[:=]\s*['\"].{6,}['\"]", r"pwd\s*[:=]\s*['\"].{6,}['\"]", r"ssn\s*[:=]\s*['\"].{9}['\"]", r"credit.*?card",
        r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}", r"api[_-]?key\s*[:=]\s*['\"].{10,}['\"]", r"secret\s*[:=]\s*['\"].{10,}['\"]",
        r"token\s*[:=]\s*['\"].{10,}['\"]", r"authorization\s*[:=]\s*['\"].{10,}['\"]", r"bearer\s+[a-z0-9]{20,}",
        r"email\s*[:=]\s*['\"][^@]+@[^@]+\.[^@]+['\"]",
    ],
    "invalid_value": [
        r"[<>]", r"\\x[0-9a-f]{2}", r"%[0-9a-f]{2}", r"\.\.", r"null", r"undefined", r"test.*?", r"admin.*?", r"or.*?1.*?=.*?1", r"';.*?--",
    ],
    "unauthorized": [
        r"admin", r"root", r"superuser", r"privilege", r"delete", r"drop", r"truncate", r"shutdown", r"\.(exe|sh|bat|php|jsp|asp)$",
        r"\.(sql|bak|old)$", r"id=\d{5,}", r"user[id]?=\d+",
    ],
    "performance": [
        r"limit\s*=\s*\d{5,}", r"rows\s*=\s*\d{5,}", r"order\s+by.*?,\s*", r"group\s+by.*?,\s*", r"recursive", r"with\s+recursive",
    ],
    "json_anomaly": [r"\{[^{}]*\{", r"\[[^\[\]]*\[", r'""[^"]*""', r"[^:]:[^:]"],
}

# Attack signatures with confidences, types in the order that wins ties.
SIGNATURES = {
    "directory traversal attack": [
        (r"\.\./", 0.9), (r"%2e%2e", 0.9), (r"/etc/(passwd|shadow|hosts)", 0.95), (r"%252f", 0.85), (r"\.\.%5c", 0.85), (r"\.\.\\", 0.85),
        (r"\.\.%2f", 0.85), (r"%2f\.\.%2f", 0.85),
    ],
    "cross-site scripting attack": [
        (r"<script", 0.95), (r"alert\(", 0.9), (r"onerror=", 0.9), (r"<svg", 0.85), (r"javascript:", 0.9), (r"%3Cscript", 0.85),
        (r"onload=", 0.85), (r"document\.cookie", 0.85),
    ],
    "unauthorized access attack": [
        (r"/admin/", 0.7), (r"/admin/(users|config|backups|logs|dashboard)", 0.8), (r"/transfer", 0.75), (r"/change-password", 0.75),
        (r"/delete-account", 0.8), (r"/api/users/export", 0.75),
    ],
    "injection attack": [
        (r"'.*OR.*=.*", 0.9), (r"UNION.*SELECT", 0.95), (r"DROP\s+TABLE", 0.95), (r"1\s*=\s*1", 0.85), (r"'.*--", 0.85),
        (r"%20OR%201=1", 0.85), (r";\s*id\b", 0.9), (r"\$\(", 0.85), (r";\s*cat\s+/etc", 0.9), (r";\s*curl\b", 0.8),
        (r"169\.254\.169\.254", 0.95), (r"file:///", 0.9), (r"\|\s*whoami", 0.9), (r"`[^`]+`", 0.8), (r"%3B.*SELECT", 0.85), (r"%3B.*%20", 0.8),
    ],
    "sensitive data leakage": [
        (r"/debug/", 0.85), (r"/\.env", 0.9), (r"/actuator", 0.9), (r"/metrics", 0.7), (r"/prometheus", 0.75), (r"/phpinfo", 0.8),
        (r"/\.git/", 0.85), (r"/config/", 0.8),
    ],
    "performance issue": [(r"page=\d{5,}", 0.85), (r"rows=\d{5,}", 0.85), (r"limit=\d{5,}", 0.8)],
    "invalid item value": [
        (r"id=-1", 0.85), (r"qty=-9", 0.85), (r"score=999", 0.85), (r"amount=-", 0.8), (r"/addresses/-", 0.8), (r"id=-\d+", 0.75), (r"qty=-\d+", 0.75),
    ],
}

# Attack types in checking order, and keyword lists.
ATTACK_TYPES = [
    "directory traversal attack", "cross-site scripting attack", "unauthorized access attack", "injection attack", "performance issue",
    "sensitive data leakage", "invalid item value",
]
CATEGORY_TYPES = {
    "sql_injection": "injection attack", "xss": "cross-site scripting attack", "directory_traversal": "directory traversal attack",
    "unauthorized_access": "unauthorized access attack", "sensitive_data_leakage": "sensitive data leakage",
    "command_injection": "injection attack", "ssrf": "injection attack", "csrf": "unauthorized access attack",
    "performance_issue": "performance issue", "invalid_item_value": "invalid item value",
}
SENSITIVE_WORDS = ["admin", "payment", "export", "backup", "config"]
KNOWN_CRAWLERS = ["googlebot", "bingbot", "baiduspider", "duckduckbot"]
SUSPICIOUS_AGENTS = ["python-requests", "curl/", "scrapy", "go-http", "okhttp", "apache-httpclient", "mj12bot", "customscraper"]
SENSITIVE_ENDPOINTS = ["/admin", "/users", "/clients", "/sales", "/beSharedItems"]
PAYLOAD_VARIANTS = [
    ("etc_passwd", ["etc/passwd", "/passwd", "passwd"]), ("etc_hosts", ["etc/hosts", "/hosts"]), ("encoded", ["%2f", "%2e"]),
    ("backup", [".sql", ".bak", "backup", "db_dump"]), ("tautology", ["or 1=1", "or '1'='1", 'or"1"="1']),
    ("union", ["union select", "union all", "union("]), ("blind", ["sleep(", "benchmark(", "waitfor delay"]),
]
