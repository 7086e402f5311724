import sys

from loomtrace.cli import main

sys.exit(main())
