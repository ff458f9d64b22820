from .attention import attention  # noqa: F401
from .dense import dense_fold  # noqa: F401
from .folds import run_fold, run_pipeline  # noqa: F401
