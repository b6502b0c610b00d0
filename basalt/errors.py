"""What the operators raise. Wrong names from fixed sets (join types, versions, presets) are ValueErrors."""


class EngineError(RuntimeError):
    """Base of all errors of operators."""


class UnknownColumn(EngineError):
    """A column that the table doesn't have; names are case sensitive."""


class TypeMismatch(EngineError):
    """Two columns whose types must be the same and are not."""


class SchemaMismatch(EngineError):
    """A schema that can't be produced or accepted."""


class UnsupportedType(EngineError):
    """A column of a type that the operator doesn't take."""


class ConfigError(EngineError):
    """Arguments that don't fit together, or a session without a needed setting."""


class Overflow(EngineError):
    """A result beyond its type, where it's found on the driver; in a job Spark raises ARITHMETIC_OVERFLOW or CAST_OVERFLOW."""
