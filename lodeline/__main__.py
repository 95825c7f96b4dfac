import sys

from lodeline.cli import main

sys.exit(main())
