"""Pipelines and the registered query catalog."""


def load_all() -> None:
    """Import every query module so that it registers itself."""
    import importlib

    for mod in ("q_scoring", "q_clean", "q_reports", "q_labels", "q_requests", "q_text", "q_models",
                "q_streams", "q_io"):
        importlib.import_module(f"storewatch.plans.{mod}")
