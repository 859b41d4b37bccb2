"""Judge-reliability analytics on Spark."""

_HOME = {"run_experiment": "plans.experiments", "load_pairs": "sources.pairs"}
__all__ = ["BIAS_CONDITION", "EXPERIMENT_SPEC", "JUDGE_EXAMPLE", "RUN_RECORD", "UNCERTAINTY_BUNDLE", *_HOME]


def __getattr__(name: str):
    """The public names, loaded when asked for: Python workers import this package too."""
    from importlib import import_module

    if name not in __all__:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_HOME.get(name, 'schemas')}"), name)
