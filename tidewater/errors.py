"""What can go wrong before Spark runs a statement."""


class EngineError(Exception):
    """Any error of the engine."""


class ParseError(EngineError):
    """The text isn't a statement of the dialect."""


class NotSupported(EngineError):
    """The statement is of the dialect, but has no meaning here."""


class BindError(EngineError):
    """A name, type or shape in the statement doesn't fit."""


class UnknownTable(BindError):
    pass


class TableExists(BindError):
    pass


class UnknownColumn(BindError):
    pass


class AmbiguousColumn(BindError):
    pass


class DuplicateName(BindError):
    pass


class JoinColumnError(BindError):
    """USING or NATURAL names that are missing, repeated or not shared."""


class AggregateError(BindError):
    """An aggregate where none may be, or a column that isn't grouped."""


class UnknownFunction(BindError):
    pass


class ArityError(BindError):
    pass


class TypeMismatch(BindError):
    pass
