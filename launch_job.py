"""spark-submit entry point for the run-all job.

    zip -r crashlens.zip crashlens
    spark-submit --py-files crashlens.zip launch_job.py OUT_DIR FORMAT units=PATH primary_person=PATH ...
    spark-submit --py-files crashlens.zip launch_job.py profile OUT_DIR FORMAT units=PATH ...
"""

from crashlens.plans.job import main

if __name__ == "__main__":
    main()
