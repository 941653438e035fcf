"""``python -m strataweave``."""

import sys

from strataweave.cli import main

sys.exit(main())
