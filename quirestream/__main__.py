import sys

from quirestream.api import main

sys.exit(main())
