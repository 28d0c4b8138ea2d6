"""Rejections of patterns and of builders."""

from __future__ import annotations


class PatternError(ValueError):
    """kind: machine-readable name; span: half-open code-unit offsets into the
    pattern, where they are known."""

    kind = "error"

    def __init__(self, message: str, pattern_id: int | None = None, span: tuple[int, int] | None = None):
        super().__init__(message)
        self.pattern_id, self.span = pattern_id, span


class DuplicatePatternId(PatternError):
    kind = "duplicate_pattern_id"

    def __init__(self, pattern_id: int):
        super().__init__(f"pattern id {pattern_id} was registered before", pattern_id)


class EmptyPattern(PatternError):
    kind = "empty_pattern"

    def __init__(self, pattern_id: int):
        super().__init__(f"pattern {pattern_id} has no characters", pattern_id)


class InvalidPattern(PatternError):
    kind = "invalid_pattern"

    def __init__(self, pattern_id: int, lo: int, hi: int):
        super().__init__(f"pattern {pattern_id} can't be read at [{lo}..{hi})", pattern_id, (lo, hi))


class UnsupportedPattern(InvalidPattern):
    """Kept for callers that tell it apart; every unsupported construct is
    reported as InvalidPattern."""

    kind = "unsupported_pattern"


class PatternNestingTooDeep(PatternError):
    kind = "pattern_nesting_too_deep"

    def __init__(self, pattern_id: int, limit: int):
        super().__init__(f"pattern {pattern_id} nests groups deeper than {limit}", pattern_id)
        self.limit = limit


class PatternTooLarge(PatternError):
    kind = "pattern_too_large"

    def __init__(self, pattern_id: int):
        super().__init__(f"pattern {pattern_id} is too large", pattern_id)


class InvalidPatternId(PatternError):
    kind = "invalid_pattern_id"

    def __init__(self, pattern_id):
        super().__init__(f"pattern id {pattern_id!r} is not an integer from 0 to 4294967295", pattern_id)


class NoPatterns(PatternError):
    kind = "no_patterns"

    def __init__(self):
        super().__init__("a matcher needs at least one pattern")


class InvalidWorkerCount(PatternError):
    kind = "invalid_worker_count"

    def __init__(self):
        super().__init__("the worker count must be at least one")


class PatternSetTooLarge(PatternError):
    kind = "pattern_set_too_large"

    def __init__(self, limit: int):
        super().__init__(f"the patterns need more than {limit} automaton states")


class InputTooLarge(PatternError):
    kind = "input_too_large"

    def __init__(self):
        super().__init__("a text is too long for one batch of 2**31 code units")
