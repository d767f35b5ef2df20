"""Entry point for spark-submit."""

from lumenward.plans.job import main

if __name__ == "__main__":
    main()
