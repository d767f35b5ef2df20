"""Entry point for spark-submit."""

from lumenward.streaming.job import main

if __name__ == "__main__":
    main()
