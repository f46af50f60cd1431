"""Word lists and patterns. All of these are fixed values: their content is behaviour."""

from __future__ import annotations

#: Words that queries, the vocabulary and distinctive terms leave out.
STOPWORDS = frozenset(
    """
    the and for are but not you all can had her was one our out has his how its may new now old see way who did get got let
    say she too use will with this that from they been have many some them than each make like just over such take into year
    your good could would about which their there other after should through also more most only very when what then these
    those being does done both same still while where here were much
    update updates updated deps dev tests test add added fix fixed run running using
    code fuzzy porter trigram prose untitled string number object
    name title label path slug key id
    """.split()
)

#: Groups of terms that stand for one another in queries.
SYNONYM_GROUPS = (
    "auth authentication authn authenticating",
    "authz authorization authorizing",
    "db database datastore",
    "perf performance latency throughput slow bottleneck",
    "optim optimization optimizing optimise",
    "k8s kubernetes kube",
    "config configuration configuring",
    "env environment",
    "fn function",
    "impl implementation implementing",
    "msg message messaging",
    "repo repository",
    "req request",
    "res response",
    "ts typescript",
    "js javascript",
    "pg postgres postgresql",
    "err error errors",
    "api endpoint endpoints",
    "ci continuous-integration",
    "cd continuous-deployment",
    "doc documentation docs",
    "infra infrastructure",
    "deploy deployment deploying",
    "cache caching cached",
    "log logging logs",
    "monitor monitoring",
    "observe observability",
    "sec security secure",
    "validate validation validating",
    "migrate migration migrations",
    "debug debugging",
    "container containerization docker",
    "webhook webhooks callback",
    "middleware mw",
    "paginate pagination",
    "serialize serialization",
    "encrypt encryption",
    "hash hashing",
)

#: Capitalised words that are no entities.
ENTITY_STOPWORDS = tuple(
    """
    The This What How When Where Why Who Which Did Does Do Is Are Was Were Has Have Had Can Could Would Should Will May Might
    If And But Or Not For From With About After Before Between
    """.split()
)

#: What is redacted, in this order. Java and RE2 syntax alike; \s is spelt out, as the two differ on it.
PRIVATE_BLOCK = r"(?is)<private>.*?</private>"
PRIVATE_MARK = "[REDACTED]"
SECRET_MARK = "[REDACTED_SECRET]"
SECRET_PATTERNS = (
    r"sk-ant-[A-Za-z0-9_-]{20,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"ghp_[A-Za-z0-9]{36}",
    r"xoxb-[A-Za-z0-9-]{10,}",
    r"AKIA[0-9A-Z]{16}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"npm_[A-Za-z0-9]{36}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"dop_v1_[A-Za-z0-9]{64}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"(?:sk|pk|rk|ak)-[A-Za-z0-9]{20,}",
    r"(?i)(?:api[_-]?key|secret|token|password|credential|auth[_-]?(?:token|key|secret|credential))[\t\n\f\r ]*[=:][\t\n\f\r ]*[\"']?[A-Za-z0-9_\-/.+]{20,}[\"']?",
)
#: One of these is in every text that a secret pattern can match (ASCII case folded).
SECRET_HINTS = ("<private>", "sk-", "pk-", "rk-", "ak-", "github_pat_", "ghp_", "xoxb-", "akia", "aiza", "npm_", "glpat-", "dop_v1_", "eyj", "key", "secret", "token", "password", "credential")

#: Words with a meaning of their own in raw full-text queries.
QUERY_KEYWORDS = ("AND", "OR", "NOT", "NEAR")


def synonyms(term: str) -> tuple[str, ...]:
    """The other terms of the term's group, or none."""
    return _SYNONYMS.get(term.lower(), ())


_SYNONYMS = {t: tuple(x for x in g.split() if x != t) for g in SYNONYM_GROUPS for t in g.split()}
