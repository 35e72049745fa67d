"""paddock: ranked-event panel analytics on Spark DataFrames."""

from .spec import PanelSpec, Params, adapter_params  # noqa: F401

__version__ = "0.1.0"
