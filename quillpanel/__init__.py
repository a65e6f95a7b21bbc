"""Entity x period indicator panels on PySpark."""

from quillpanel.session import get_session, stage
from quillpanel.spec import FeatureSpec, PanelSpec

__all__ = ["FeatureSpec", "PanelSpec", "get_session", "stage"]
