"""What can go wrong, by kind."""


class EngineError(Exception):
    """Base of all errors of the engine."""


class ParseError(EngineError):
    pass


class UnknownName(EngineError):
    """A table, column, function, trigger, procedure or savepoint that does not exist."""


class AlreadyExists(EngineError):
    pass


class ConstraintViolation(EngineError):
    """NOT NULL, PRIMARY KEY, UNIQUE, FOREIGN KEY, or a Datalog constraint (then with `count`)."""

    def __init__(self, message: str, count: int | None = None):
        super().__init__(message)
        self.count = count


class TriggerAbort(EngineError):
    """RAISE ERROR in a trigger."""


class TriggerDepth(EngineError):
    pass


class TransactionError(EngineError):
    pass


class UnsafeRule(EngineError):
    pass


class NotStratified(EngineError):
    pass


class TooManyRounds(EngineError):
    """A recursion that did not end within the given number of rounds."""
