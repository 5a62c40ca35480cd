"""Keyword rules compiled to Column expressions: issue types, severity, reply choice and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom.functions import fixed_values as fv
from reviewloom.functions import text as tx


def _norm_all(words: Sequence[str]) -> list[str]:
    return [tx.normalize_word(w) for w in words]


@dataclass(frozen=True)
class IssueRules:
    """Issue dictionary and severity word lists. Words are compared on normalised text."""

    issue_types: Mapping[str, Sequence[str]] = field(default_factory=lambda: fv.ISSUE_KEYWORDS)
    high_triggers: Sequence[str] = tuple(fv.HIGH_SEVERITY_TRIGGERS)
    negative_signals: Sequence[str] = tuple(fv.NEGATIVE_SIGNALS)
    positive_signals: Sequence[str] = tuple(fv.POSITIVE_SIGNALS)
    risky_types: Sequence[str] = tuple(fv.RISKY_TYPES)
    complaint_types: Sequence[str] = tuple(fv.COMPLAINT_TYPES)
    other: str = fv.ISSUE_OTHER

    def matched_types(self, norm: Column) -> Column:
        """Types with a keyword in the text, in dictionary order; may be empty."""
        return tx.flag_array([
            (tx.contains_any(norm, _norm_all(words)), F.lit(name))
            for name, words in self.issue_types.items()
        ])

    def or_other(self, matched: Column) -> Column:
        return F.when(F.size(matched) > 0, matched).otherwise(F.array(F.lit(self.other)))

    def severity(self, norm: Column, rating: Column, types: Column) -> Column:
        """First rule that holds wins; a missing rating satisfies no rating test."""
        low_stars = F.coalesce(rating <= fv.NEGATIVE_RATING_MAX, F.lit(False))
        high_stars = F.coalesce(rating >= 4, F.lit(False))
        trigger = tx.contains_any(norm, _norm_all(self.high_triggers))
        negative = tx.contains_any(norm, _norm_all(self.negative_signals))
        positive = tx.contains_any(norm, _norm_all(self.positive_signals))
        risky = _overlaps(types, self.risky_types)
        complaint = _overlaps(types, self.complaint_types)
        return (
            F.when(trigger | (risky & low_stars), "high")
            .when(high_stars & positive & ~complaint & ~negative, "positive")
            .when(negative | low_stars | complaint, "medium")
            .otherwise("low")
        )


def _overlaps(types: Column, names: Sequence[str]) -> Column:
    if not names:
        return F.lit(False)
    return F.coalesce(F.arrays_overlap(types, F.array(*[F.lit(n) for n in names])), F.lit(False))


@dataclass(frozen=True)
class ReplyPolicy:
    """Reply choice, templates, forced-review conditions, safety patterns and scoring words."""

    severity_to_type: Mapping[str, str] = field(default_factory=lambda: fv.SEVERITY_TO_REPLY_TYPE)
    templates: Mapping[str, str] = field(default_factory=lambda: fv.REPLY_TEMPLATES)
    reviewed_types: Sequence[str] = tuple(fv.REVIEWED_REPLY_TYPES)
    positive_type: str = fv.POSITIVE_REPLY_TYPE
    fallback_type: str = fv.FALLBACK_REPLY_TYPE
    force_severities: Sequence[str] = tuple(fv.FORCE_REVIEW_SEVERITIES)
    force_types: Sequence[str] = tuple(fv.FORCE_REVIEW_TYPES)
    force_keywords: Sequence[str] = tuple(fv.FORCE_REVIEW_KEYWORDS)
    banned_phrases: Sequence[str] = tuple(fv.BANNED_PHRASES)
    safety_patterns: Mapping[str, Sequence[Sequence[str]]] = field(
        default_factory=lambda: fv.SAFETY_PATTERNS)
    polite_pattern: str = fv.POLITE_PATTERN
    empathy_words: Sequence[str] = tuple(fv.EMPATHY_WORDS)
    action_words: Sequence[str] = tuple(fv.ACTION_WORDS)
    contact_default: str = fv.CONTACT_DEFAULT
    contact_security: str = fv.CONTACT_SECURITY
    tone: str = fv.TONE_TEXT

    def reply_type(self, severity: Column, sentiment: Column) -> Column:
        choice = None
        for sev, rtype in self.severity_to_type.items():
            choice = (F if choice is None else choice).when(severity == sev, rtype)
        positive = sentiment == "positive"
        if choice is None:
            return F.when(positive, self.positive_type).otherwise(self.fallback_type)
        return choice.when(positive, self.positive_type).otherwise(self.fallback_type)

    def type_needs_review(self, reply_type: Column) -> Column:
        return F.coalesce(reply_type.isin(list(self.reviewed_types)), F.lit(False))

    def force_review_flags(self, norm: Column, severity: Column, types: Column) -> Column:
        """Conditions that force a human review, rendered as texts; empty when none holds."""
        hit_types = F.array_sort(F.array_intersect(
            types, F.array(*[F.lit(t) for t in self.force_types]))) if self.force_types else (
                F.array().cast("array<string>"))
        words = list(self.force_keywords)
        hit_words = tx.present_words(norm, _norm_all(words), words)
        return tx.flag_array([
            (severity.isin(list(self.force_severities)), F.concat(F.lit("severity="), severity)),
            (F.size(hit_types) > 0, F.concat(F.lit("issue_types="), _list_text(hit_types))),
            (F.size(hit_words) > 0, F.concat(F.lit("keywords="), _list_text(hit_words))),
        ])

    def safety_flags(self, reply: Column, norm: Column) -> Column:
        """One flag per banned phrase found, then one per pattern family."""
        banned = [(norm.contains(tx.normalize_word(p)), F.lit(f"banned_phrase:{p}"))
                  for p in self.banned_phrases]
        families = []
        for name, groups in self.safety_patterns.items():
            hits = []
            for group in groups:
                hit = F.lit(True)
                for pattern in group:
                    hit = hit & reply.rlike(tx.unix_lines(pattern))
                hits.append(hit)
            families.append((tx.any_of(hits), F.lit(name)))
        return tx.flag_array(banned + families)

    def draft(self, reply_type: Column, app_name: Column) -> Column:
        """Template of the reply type with the app name filled in."""
        fallback = self.templates[self.fallback_type]
        out = None
        for rtype, template in self.templates.items():
            out = (F if out is None else out).when(reply_type == rtype, F.lit(template))
        return F.replace(out.otherwise(F.lit(fallback)), F.lit("{app}"), F.coalesce(app_name, F.lit("")))

    def tone_score(self, reply: Column) -> Column:
        """0 for an empty reply; else 1, +1 polite ending, +1 for two to four sentences."""
        sentences = F.size(F.filter(F.split(reply, tx.unix_lines(fv.SENTENCE_SPLIT)), tx.not_blank))
        return F.when(F.coalesce(F.length(reply), F.lit(0)) == 0, 0).otherwise(
            1 + reply.rlike(self.polite_pattern).cast("int") + sentences.between(2, 4).cast("int"))

    def helpfulness_score(self, reply: Column) -> Column:
        """0 for an empty reply; else 1, +1 empathy word, +1 action word."""
        return F.when(F.coalesce(F.length(reply), F.lit(0)) == 0, 0).otherwise(
            1 + tx.contains_any(reply, self.empathy_words).cast("int")
            + tx.contains_any(reply, self.action_words).cast("int"))


def _list_text(items: Column) -> Column:
    """['a', 'b'] as text."""
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def load_issue_rules(path: str) -> IssueRules:
    """Issue dictionary from a YAML file (sections issue_types, high_severity_triggers,
    negative_signals, positive_signals). Read once on the driver: a dictionary, not data."""
    data = _read_yaml(path)
    return IssueRules(
        issue_types={t: tuple(words) for t, words in (data.get("issue_types") or {}).items()},
        high_triggers=tuple(data.get("high_severity_triggers") or ()),
        negative_signals=tuple(data.get("negative_signals") or ()),
        positive_signals=tuple(data.get("positive_signals") or ()),
    )


def load_reply_policy(path: str) -> ReplyPolicy:
    """Reply policy from a YAML file (severity_to_reply_type, reply_types, banned_phrases,
    force_human_review, contact_guidance, tone)."""
    data = _read_yaml(path)
    force = data.get("force_human_review") or {}
    contact = data.get("contact_guidance") or {}
    tone = data.get("tone") or {}
    types = data.get("reply_types") or {}
    tone_text = "{}, {}~{}문장".format(
        tone.get("style", "공손한 존댓말"), tone.get("sentences_min", 2), tone.get("sentences_max", 4))
    return ReplyPolicy(
        severity_to_type=data.get("severity_to_reply_type") or {},
        reviewed_types=tuple(t for t, spec in types.items() if (spec or {}).get("needs_human_review")),
        force_severities=tuple(force.get("severities") or ()),
        force_types=tuple(force.get("issue_types") or ()),
        force_keywords=tuple(force.get("keywords") or ()),
        banned_phrases=tuple(data.get("banned_phrases") or ()),
        contact_default=contact.get("default", ""),
        contact_security=contact.get("security", ""),
        tone=tone_text,
    )


def _read_yaml(path: str) -> dict:
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("reading a dictionary file needs the yaml package") from exc
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}
