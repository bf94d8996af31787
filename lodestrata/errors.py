"""What can go wrong, by name."""


class EngineError(Exception):
    """Base of all errors raised on purpose."""


class ParseError(EngineError):
    """The SQL text isn't in the dialect."""


class BindError(EngineError):
    """A column or literal doesn't fit the schema."""


class IncompleteData(EngineError):
    """The loaded data cannot be proven to answer the query completely."""


class ConditionFailed(EngineError):
    """A conditional write found no row, or one that fails its condition."""


class WriteConflict(EngineError):
    """Another writer published first, time after time."""


class ReadOnly(EngineError):
    """The engine is switched to read-only."""
