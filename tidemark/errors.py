"""Errors that are raised while a plan is compiled, before Spark runs anything."""


class PlanError(ValueError):
    """A plan that can't be run."""


class UnknownTable(PlanError):
    pass


class UnknownColumn(PlanError):
    pass


class AmbiguousColumn(PlanError):
    pass


class TypeMismatch(PlanError):
    pass
