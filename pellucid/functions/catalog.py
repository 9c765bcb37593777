"""The phrase rules, and what assessments are made of.

Rules are data: ``catalog.json`` lists the built-in ones in catalogue order, and ``load_rules`` reads a file of
the same form. A signal holds if one of its alternatives occurs.
"""

from __future__ import annotations

import json
import pathlib
import re
from dataclasses import dataclass

BUILT_IN = pathlib.Path(__file__).with_name("catalog.json")
KINDS = ("required", "optional", "forbidden")

# Impact of a category, and severity by evidence and impact.
IMPACT = {
    "instruction-override": "medium", "authority-impersonation": "medium", "sensitive-disclosure": "medium",
    "safety-bypass": "medium", "hidden-action": "medium", "role-manipulation": "low", "coercion": "low",
    "agent-directed-action": "low", "custom": "low",
}
#: Severity by evidence (weak, moderate, strong) and impact (low, medium, high).
SEVERITY = [
    ("weak", "low", "low"), ("weak", "medium", "low"), ("weak", "high", "medium"),
    ("moderate", "low", "low"), ("moderate", "medium", "medium"), ("moderate", "high", "high"),
    ("strong", "low", "medium"), ("strong", "medium", "medium"), ("strong", "high", "high"),
]
# End of the fixed values.

_TOKEN = re.compile(r"[^\W_]+")


def tokens(text: str) -> str:
    """Words of letters, marks and digits, lower-cased, one space apart."""
    return " ".join(_TOKEN.findall(text.lower()))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    primary: bool
    signals: dict[str, dict[str, list[str]]]

    @property
    def category(self) -> str:
        return self.rule_id.split(".")[0]

    @property
    def language(self) -> str:
        return self.rule_id.split(".")[1]

    @property
    def action_group(self) -> str:
        return f"{self.category}.{self.rule_id.split('.')[2]}"

    def of(self, kind: str) -> list[tuple[str, list[str]]]:
        return list(self.signals[kind].items())


def load_rules(path: str | pathlib.Path = BUILT_IN) -> list[Rule]:
    """The rules of a file, in its order: matches are cut in this order."""
    found = json.loads(pathlib.Path(path).read_text(encoding="utf-8"))["rules"]
    return [Rule(r["id"], r["primary"], {kind: r[kind] for kind in KINDS}) for r in found]


RULES = load_rules()


def phrase_rows(rules: list[Rule] = RULES) -> list[tuple]:
    """(ord, rule_id, category, action_group, is_primary, kind, signal_id, phrase), phrases as tokens."""
    return [
        (k, r.rule_id, r.category, r.action_group, r.primary, kind, signal, phrase)
        for k, r in enumerate(rules)
        for kind in KINDS
        for signal, phrases in r.of(kind)
        for phrase in dict.fromkeys(tokens(p) for p in phrases)
    ]
