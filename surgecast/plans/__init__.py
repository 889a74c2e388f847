"""Named query plans over the driver's test tables, and the jobs that compose operators."""
