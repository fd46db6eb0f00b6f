"""Errors of the driver side; problems of single rows are columns, not exceptions."""

from __future__ import annotations


class EngineError(Exception):
    """A message, a code and context."""

    code = "ENGINE_ERROR"

    def __init__(self, message: str, code: str | None = None, **context):
        super().__init__(message)
        self.message, self.context = message, context
        if code:
            self.code = code


class InvalidContractError(EngineError):
    code = "INVALID_CONTRACT"


class UnsupportedFieldTypeError(InvalidContractError):
    code = "UNSUPPORTED_FIELD_TYPE"


class InvalidConstraintError(InvalidContractError):
    code = "INVALID_CONSTRAINT"


class InvalidPathError(InvalidContractError, ValueError):
    code = "INVALID_PATH"


class InvalidSemanticTagError(InvalidContractError):
    code = "INVALID_SEMANTIC_TAG"


class PlanningError(EngineError):
    code = "PLANNING_ERROR"


class ExecutionError(EngineError):
    code = "EXECUTION_ERROR"


class CapabilityError(ExecutionError):
    code = "CAPABILITY_ERROR"


class InferenceProviderError(CapabilityError):
    code = "INFERENCE_PROVIDER_ERROR"


class BudgetExceededError(ExecutionError):
    code = "BUDGET_EXCEEDED"


class ReconciliationError(ExecutionError):
    code = "RECONCILIATION_ERROR"


class ReplayError(EngineError):
    code = "REPLAY_ERROR"


class VersionMismatchError(ReplayError):
    code = "VERSION_MISMATCH"


class HashMismatchError(ReplayError):
    code = "HASH_MISMATCH"


class CapabilityNotFoundError(ReplayError):
    code = "CAPABILITY_NOT_FOUND"


class ConfigurationError(EngineError):
    code = "CONFIGURATION_ERROR"


class InvalidBudgetError(ConfigurationError, ValueError):
    code = "INVALID_BUDGET"


class InvalidPolicyError(ConfigurationError, ValueError):
    code = "INVALID_POLICY"


class MoneyError(EngineError):
    code = "MONEY_ERROR"


class CurrencyMismatchError(MoneyError):
    code = "CURRENCY_MISMATCH"


class MissingFxRateError(MoneyError):
    code = "MISSING_FX_RATE"


class InvalidFxRateError(MoneyError):
    code = "INVALID_FX_RATE"
